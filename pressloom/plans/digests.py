"""The digest run: what alerts can be sent about, from recent coverage and recent fact checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressloom.functions import dates, text
from pressloom.operators import coverage, tagging


def digest_run(tagged: DataFrame, checks: DataFrame, now: Column, story_hours: int = 20, fresh_hours: int = 6, check_hours: int = 24, grow: bool = False) -> DataFrame:
    """Digests of the most covered fresh stories among the news of ``story_hours``, and of the newest denials.

    ``tagged``: tagged headlines with source_name. ``checks``: fact checks with id, title, url, kind, published, source_name. ``grow``: see ``coverage.group_stories``.
    """
    recent = tagged.where((F.col("kind") == "noticia") & (dates.age_hours(F.col("published"), now) < story_hours))
    members = coverage.group_stories(recent, text.grouping_tokens(F.col("title")), grow)
    stories = coverage.story_digests(members, now, fresh_hours=fresh_hours)
    return stories.unionByName(coverage.alert_digests(tagging.denial_alerts(checks, now, hours=check_hours)))
