"""Licence scan by digests: whole texts, and whole lines, in a normal form, joined to the digests of known licences.

The normal form drops copyright lines, lowers the letters, writes equivalent spellings one way, and keeps letters and digits only,
parted by one space. Nothing but an equal normal form matches; a text with copyright lines behind comment marks is also
looked up without those lines. ``digest`` is that of the form with them.

Defined results: a null or empty text, and one of punctuation only, has the digest of the empty form, which matches nothing; texts are read
whole; equal rows get equal results; a line matching two identifiers counts for both; ids may be null or repeat; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.llm import base
from pressloom.llm.license_texts import DIGESTS, KNOWN, SPELLINGS

COPYRIGHT_LINE = r"(?m)^[ \t]*(?:copyright|\(c\)|©)[ \t].*$"
MARKED_COPYRIGHT_LINE = r"(?m)^[ \t#*/;%!<|-]*(?:copyright|\(c\)|©)[ \t].*$"  # also behind comment marks
HAS_MARKED = r"(?im)^[ \t]*[#*/;%!<|-][ \t#*/;%!<|-]*(?:copyright|\(c\)|©)[ \t]"


def normal_form(text: Column, dropped: str = COPYRIGHT_LINE) -> Column:
    out = F.regexp_replace(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), dropped, " ")
    out = F.concat(F.lit(" "), F.regexp_replace(out, "[^a-z0-9]+", " "), F.lit(" "))
    for other, usual in SPELLINGS:
        out = F.replace(out, F.lit(other), F.lit(usual))
    return F.trim(F.regexp_replace(out, " +", " "))


def normal_form_of(text: str) -> str:
    """The same form of one text, for the known licences."""
    out = re.sub(COPYRIGHT_LINE, " ", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    out = " " + re.sub("[^a-z0-9]+", " ", out) + " "
    for other, usual in SPELLINGS:
        out = out.replace(other, usual)
    return re.sub(" +", " ", out).strip()


def known_digests(spark: SparkSession, known=KNOWN, digests=DIGESTS) -> DataFrame:
    """license, kind, digest: one row for each known text or notice, so its size is that of the given list."""
    rows = sorted({(name, kind, hashlib.sha256(normal_form_of(text).encode()).hexdigest()) for name, kind, text in known if normal_form_of(text)} | {(name, "text", digest) for name, digest in digests})
    return spark.createDataFrame(rows, "license string, kind string, digest string")


def scan_licenses(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Per document: digest of its normal form, the licences whose text it is, the licences that its lines name, the number of those lines."""
    docs = base.texts(docs).withColumn("key", base.row_key())
    known = F.broadcast(known)
    whole = docs.select("key", "doc_id", F.sha2(normal_form(F.col("text")), 256).alias("digest"), F.when(F.col("text").rlike(HAS_MARKED), F.sha2(normal_form(F.col("text"), MARKED_COPYRIGHT_LINE), 256)).alias("bare"))
    lines = (
        docs.select("key", F.explode(F.split("text", "\n")).alias("line")).where("line != ''")
        .select("key", F.sha2(normal_form(F.col("line")), 256).alias("digest")).join(known.where("kind = 'notice'"), "digest")
    )
    named = lines.groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices"), F.count("*").alias("n_notice_lines"))
    copies = docs.groupBy("key").agg(F.count("*").alias("copies"))
    named = named.join(copies, "key").select("key", "notices", F.expr("n_notice_lines div copies").alias("n_notice_lines"))
    texts = known.where("kind = 'text'").groupBy("digest").agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("license"))
    bare = texts.select(F.col("digest").alias("bare"), F.col("license").alias("bare_license"))
    return whole.join(F.broadcast(texts), "digest", "left").join(F.broadcast(bare), "bare", "left").join(named, "key", "left").select(
        "doc_id", "digest", F.coalesce("license", "bare_license").alias("license"), "notices", F.coalesce("n_notice_lines", F.lit(0)).cast("long").alias("n_notice_lines")
    )


def _oracle() -> str:
    def form(x: str) -> str:
        out = rf"regexp_replace(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(?m)^[ \t]*(?:copyright|\(c\)|©)[ \t].*$', ' ', 'g')"
        out = f"' ' || regexp_replace({out}, '[^a-z0-9]+', ' ', 'g') || ' '"
        for other, usual in SPELLINGS:
            out = f"replace({out}, '{other}', '{usual}')"
        return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"

    def texts(kind: str) -> str:
        return ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, k, text in KNOWN if k == kind)

    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
    notice AS (SELECT DISTINCT name, sha256({form('t')}) AS digest FROM (VALUES {texts('notice')}) AS v(name, t)),
    license AS (SELECT digest, string_agg(DISTINCT name, ',' ORDER BY name) AS license FROM (SELECT name, sha256({form('t')}) AS digest FROM (VALUES {texts('text')}) AS v(name, t)) GROUP BY digest),
    lines AS (SELECT r, sha256({form('line')}) AS digest FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE line <> ''),
    named AS (SELECT r, string_agg(DISTINCT name, ',' ORDER BY name) AS notices, count(*) AS n FROM lines JOIN notice USING (digest) GROUP BY r),
    whole AS (SELECT r, doc_id, sha256({form('text')}) AS digest FROM d)
    SELECT doc_id, digest, license, notices, coalesce(n, 0) AS n_notice_lines FROM whole LEFT JOIN license USING (digest) LEFT JOIN named USING (r)
    """


@base.query("op3_license_digests", _oracle())
def op3_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(base.table(spark, sf_dir, "documents"), known_digests(spark))
