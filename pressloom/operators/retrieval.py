"""Term-overlap retrieval: queries and titles meet block by block, and common terms are counted there (``operators/overlap.py``).

Where only the best titles are asked for, only the best of each block become rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressloom.functions import text, urls, verdicts
from pressloom.functions import fixed_values as fv
from pressloom.operators.overlap import numbered, shared_words
from pressloom.operators.ranking import first_per_group, top_per_group
from pressloom.session import cut_lineage


def postings(docs: DataFrame, doc: str, terms: Column) -> DataFrame:
    return docs.select(doc, F.explode(terms).alias("term"))


def term_weights(docs: DataFrame) -> DataFrame:
    """``docs``: doc, terms (distinct). Document frequency and idf = ln(N / df), N at least 2."""
    total = docs.agg(F.greatest(F.count(F.lit(1)), F.lit(2)).alias("total"))
    df = docs.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(total)).select("term", "df", F.log(F.col("total") / F.col("df")).alias("idf"))  # one row


def find(queries: DataFrame, index: DataFrame, needed: Column, terms: str = "terms", told: tuple[list[str], list[str]] = ([], []), limit: int | None = None, order: list[Column] | None = None) -> DataFrame:
    """Index rows sharing at least ``needed`` terms with each query: qid, did, shared, and the columns of both sides named in ``told``.

    ``queries``: qid and an array of distinct terms; ``index``: did, terms. All pairs, however many there are. Each of n equal queries gives
    its pairs n times, unless a column times says how often. With ``limit``, for each query at least so many of its best rows, by the terms shared and then by ``order``.
    """
    kept = queries.where(F.col("qid").isNotNull() & (needed >= 1))
    kept = kept if "times" in queries.columns else kept.withColumn("times", _equal(terms))
    kept = kept.withColumn("__time", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))))
    asked = numbered(kept.select("qid", F.col(terms).alias("words"), needed.alias("needed"), *told[0]), "q")
    rows = numbered(index.where(F.size("terms") > 0).select("did", F.col("terms").alias("words"), F.lit("").alias("key"), *told[1]), "o", *(order or []))
    pairs = shared_words(asked, rows, limit, limit, (["qid", *told[0]], ["did", *told[1]]))
    return pairs.select("qid", "did", "shared", *told[0], *told[1])


def _signature(terms: str) -> Column:
    return F.md5(F.array_join(F.array_sort(terms), " "))


def _equal(terms: str) -> Column:
    return F.count(F.lit(1)).over(Window.partitionBy("qid", _signature(terms)))


def title_matches(queries: DataFrame, index: DataFrame, needed: Column, limit: int | None = None) -> DataFrame:
    """Every article whose title shares enough terms with a query: qid, id, published, shared.

    With ``limit``, for each query at least so many of its best articles (``best_order``).
    """
    titles = index.select(F.col("id").alias("did"), "published", text.retrieval_tokens(F.col("title")).alias("terms"))
    found = find(queries, titles, needed, told=([], ["published"]), limit=limit, order=[F.col("published").desc(), F.col("did").asc()] if limit else None)
    return found.select("qid", F.col("did").alias("id"), "published", "shared")


def best_order() -> list[Column]:
    """More shared terms first, then newest, then index order."""
    return [F.col("shared").desc(), F.col("published").desc(), F.col("id").asc()]


def coverage_candidates(claims: DataFrame, index: DataFrame, per_outlet: int = 2, limit: int = 8) -> DataFrame:
    """Headlines that may cover a claim.

    ``claims``: qid, b (query terms), w (query and claim terms). ``index``: id, title, url, kind, published. A headline
    counts with three terms of ``w`` (all, if fewer), or with 60 % of at most four query terms. Fact checks are left out.
    """
    public = index.where((F.col("kind") != "checagem") & urls.is_public(F.col("url")))
    described = public.withColumn("terms", text.retrieval_tokens(F.col("title"))).withColumn("outlet", urls.outlet_key(F.col("url")))
    newest = [F.col("published").desc(), F.col("id").asc()]
    news = top_per_group(described.withColumn("sig", _signature("terms")), ["sig", "outlet"], newest, per_outlet)  # copies rank alike
    placed = numbered(news.where(F.size("terms") > 0), "o", *newest)
    by_query = F.size("b").between(1, 4)
    asked = claims.where(F.col("qid").isNotNull() & (F.size("w") > 0)).select(
        "qid", F.col("w").alias("words"), F.least(F.lit(fv.MIN_SHARED_TERMS), F.size("w")).alias("needed"),
        F.when(by_query, F.col("b")).alias("few"), F.when(by_query, F.ceil(F.lit(0.6) * F.size("b"))).otherwise(0).alias("few_needed"),
    )
    asked = numbered(asked, "q")
    hits = shared_words(asked, placed.select("o", F.col("terms").alias("words"), F.col("outlet").alias("key")), per_outlet, limit)
    ranked = (
        hits.join(asked.select("q", "qid"), "q")
        .join(placed.select("o", "id", "title", "url", "published", "source", "grupo", "desc", "outlet"), "o")
        .drop("q", "o")
    )
    return cap_per_outlet(ranked, per_outlet, limit)


def cap_per_outlet(candidates: DataFrame, per_outlet: int = 2, limit: int = 8) -> DataFrame:
    """At most ``per_outlet`` rows of an outlet and ``limit`` rows per claim, in retrieval order."""
    few = top_per_group(candidates, ["qid", "outlet"], best_order(), per_outlet)
    return top_per_group(few, ["qid"], best_order(), limit, rank="place")


def merge_candidates(local: DataFrame, external: DataFrame, per_outlet: int = 2, limit: int = 8) -> DataFrame:
    """Local rows first, then external ones, without repeating a link; ``pos`` is the order within each list."""
    both = local.withColumn("part", F.lit(0)).unionByName(external.withColumn("part", F.lit(1)))
    link = urls.without_slash(F.col("url"))
    order = [F.col("part").asc(), F.col("pos").asc()]
    unique = first_per_group(both.withColumn("link", link), ["qid", "link"], order)
    few = top_per_group(unique, ["qid", "outlet"], order, per_outlet)
    return top_per_group(few, ["qid"], order, limit, rank="place").drop("link")


def same_story(articles: DataFrame, index: DataFrame) -> DataFrame:
    """Per article the best row of each other outlet, source, kind and group, among the rows that share three topic terms with its title.

    ``articles``: id, title, url, source. ``index``: id, title, url, source, kind, grupo, published. Articles with the same
    topic terms and outlet ask the same question, and copies of a title inside an outlet give the same answer, so both sides
    are folded before they meet; ``questions`` maps the folded question back to the articles.
    """
    group = ["outlet", "source", "kind", "grupo"]
    folded = (
        index.withColumn("terms", text.retrieval_tokens(F.col("title")))
        .withColumn("outlet", urls.outlet_key(F.col("url")))
        .groupBy(_signature("terms").alias("did"), *group)
        .agg(F.first("terms").alias("terms"), F.min_by(F.struct("id", "title", "url", "published"), F.struct(-F.unix_micros("published"), "id")).alias("row"))
    )
    candidates = numbered(folded.where(F.size("terms") > 0).select("terms", *group, "row.*"), "o", *best_order()[1:])
    asked = questions(articles).select("qid", "q_terms", "q_outlet", "q_source").distinct().withColumn("set", _signature("q_terms"))
    sets = numbered(asked.groupBy("set").agg(F.first("q_terms").alias("words"), F.lit(fv.MIN_SHARED_TERMS).alias("needed")), "q")
    hits = shared_words(sets, candidates.select("o", F.col("terms").alias("words"), F.to_json(F.struct(*group)).alias("key")), per_key=1)
    met = hits.join(sets.select("q", "set"), "q").join(candidates.drop("terms"), "o")
    best = top_per_group(met, ["q", *group], best_order(), 1)
    return (
        best.join(asked, "set")
        .where((F.col("outlet") != F.col("q_outlet")) & (F.col("source") != F.col("q_source")))
        .select("qid", *group, "shared", "id", "title", "url", "published")
    )


def questions(articles: DataFrame) -> DataFrame:
    """Article ids with the folded question they ask; titles with fewer than three topic terms ask none."""
    q = articles.select(
        F.col("id").alias("article"), text.topic_terms(F.col("title")).alias("q_terms"), urls.outlet_key(F.col("url")).alias("q_outlet"),
        F.col("source").alias("q_source"),
    ).where(F.size("q_terms") >= fv.MIN_SHARED_TERMS)
    return q.withColumn("qid", F.md5(F.concat_ws("|", F.array_join(F.array_sort("q_terms"), " "), "q_outlet", "q_source")))


def other_outlets(hits: DataFrame, limit: int = 4) -> DataFrame:
    """The best row of each other outlet, at most ``limit`` per question."""
    best = first_per_group(hits, ["qid", "outlet"], best_order())
    return top_per_group(best, ["qid"], best_order(), limit, rank="place")


def outlet_counts(articles: DataFrame, hits: DataFrame, official: int = 2) -> DataFrame:
    """Outlets with the same story (own one included) and up to two official sources; null when the title is too short."""
    is_official = F.col("grupo") == "oficial"
    news = hits.where(~is_official & (F.col("kind") != "checagem")).groupBy("qid").agg(F.count_distinct("outlet").alias("others"))
    best = first_per_group(hits.where(is_official), ["qid", "outlet"], best_order())
    officials = (
        top_per_group(best, ["qid"], best_order(), official, rank="place")
        .groupBy("qid")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias("oficiais"))
    )
    answers = questions(articles).select("article", "qid").join(news, "qid", "left").join(officials, "qid", "left")
    return articles.join(answers.withColumnRenamed("article", "id"), "id", "left").select(
        "id",
        F.when(F.col("qid").isNotNull(), F.coalesce("others", F.lit(0)) + 1).alias("veiculos"),
        F.coalesce("oficiais", F.array().cast("array<string>")).alias("oficiais"),
    )


def index_checks(claims: DataFrame, index: DataFrame, told: tuple[str, ...] = ("id", "title", "url", "published", "source"), best: int | None = None) -> DataFrame:
    """Fact checks of the index about a claim: qid, id, title, url, published, source, classe (empty = merely related), shared.

    ``claims``: qid, terms, negado. Pairs are many: of the index they bring only the columns ``told``. A title's verdict is read once.
    With ``best``, only so many links of each claim that rank best (``_best_index_checks``).
    """
    if best:
        return _best_index_checks(claims, index, best)
    public = _read_checks(index)
    asked = claims.withColumn("times", _equal("terms")).join(claims.select("qid", F.col("negado").alias("sense")), "qid")  # as often as a claim's number comes
    hits = find(
        asked.select("qid", "terms", "times", "sense"), public.withColumn("did", F.lit(None).cast("string")), F.least(F.lit(fv.MIN_SHARED_TERMS), F.size("terms")),
        told=(["sense"], ["class", "negated", *told]),
    )
    return hits.withColumn("classe", verdicts.sense_guarded(F.col("class"), F.col("negated"), F.col("sense"))).drop("did", "class", "negated", "sense")


def _read_checks(index: DataFrame) -> DataFrame:
    """Public fact checks with the terms and the verdict of their titles."""
    title = F.col("title")
    public = index.where((F.col("kind") == "checagem") & urls.is_public(F.col("url")) & title.isNotNull())
    return public.select("*", text.retrieval_tokens(title).alias("terms"), verdicts.title_class(title).alias("class"), verdicts.remainder_negated(title).alias("negated"))


def delivered_checks(claims: DataFrame, results: DataFrame) -> DataFrame:
    """Results of an external fact-check search, kept when they are about the claim and link to a public page.

    ``results``: qid, rid, claim_text, review_title, rating, url, published, publisher. ``claims``: qid, terms, negado.

    Results are many more than their texts, so the distinct texts and labels are read, and results meet what was found by numbers:
    the words of a claim that its text lacks are looked for in the title.
    """
    plain = lambda c: F.coalesce(c, F.lit(""))
    number = lambda c: F.xxhash64(plain(c))
    hashed = lambda words: F.transform(words, lambda w: F.xxhash64(w))
    kinds = [F.struct(F.lit(rates).alias("rates"), plain(c).alias("text")) for c, rates in (("claim_text", False), ("review_title", False), ("rating", True))]
    public = results.where(urls.is_public(F.col("url")))
    distinct = cut_lineage(public.select(F.explode(F.array(*kinds)).alias("t")).select("t.*").distinct())
    value = F.col("text")
    said = cut_lineage(distinct.where("not rates").select(number(value).alias("n"), hashed(text.retrieval_tokens(value)).alias("found"), verdicts.is_negated(value).alias("denies"), (value == "").alias("empty")))
    rated = cut_lineage(distinct.where("rates").select(number(value).alias("__rating"), verdicts.rating_class(value).alias("class")))
    asking = claims.select("qid", hashed("terms").alias("terms"), "negado")
    asked = cut_lineage(
        public.select("qid", number("claim_text").alias("__said")).distinct().join(asking, "qid").join(said.withColumnRenamed("n", "__said"), "__said").select(
            "qid", "__said", "negado", F.when(~F.col("empty"), F.col("denies")).alias("denies"), F.size(F.array_intersect("terms", "found")).alias("got"),
            F.array_except("terms", "found").alias("rest"), F.least(F.lit(2), F.size("terms")).alias("needed"),
        )
    )
    titles = said.select(F.col("n").alias("__title"), F.col("found").alias("title_found"), F.col("denies").alias("title_denies"))
    keyed = public.withColumns({"__said": number("claim_text"), "__title": number("review_title"), "__rating": number("rating")})
    met = keyed.join(rated, "__rating").join(titles, "__title").join(asked, ["qid", "__said"])
    shared = F.col("got") + F.size(F.array_intersect("rest", "title_found"))
    classe = verdicts.sense_guarded(F.col("class"), F.coalesce("denies", "title_denies"), F.col("negado"))
    return met.withColumn("shared", shared).where(F.col("shared") >= F.col("needed")).select(*results.columns, "shared", classe.alias("classe"))


def merged_checks(claims: DataFrame, index: DataFrame, results: DataFrame, limit: int = 5, ahead: int | None = None) -> DataFrame:
    """The merged list (``merge_checks``) of a claim's delivered results and of the index, written. ``claims``: qid, terms, negado.

    Of the index only the ``ahead`` best links of a claim are taken, as links that were delivered are no longer counted there. Claims whose
    list could still change by a link behind these are merged again with more of them, until there is none.
    """
    outside = delivered_checks(claims, results).select("qid", F.lit(0).alias("part"), F.col("rid").cast("long").alias("pos"), "url", "classe", "shared")
    key = lambda: F.struct((F.col("classe") == "").alias("related"), (-F.col("shared")).alias("fewer"), "part", "pos")
    ahead, merged, left = ahead or 2 * limit, None, None
    while True:
        some = claims if left is None else claims.join(left, "qid", "left_semi")
        own = cut_lineage(index_checks(some, index, best=ahead))
        lists = (outside if left is None else outside.join(left, "qid", "left_semi")).unionByName(own.drop("q"))
        now = cut_lineage(merge_checks(lists, limit))
        behind = own.groupBy("qid", "q").agg(F.count(F.lit(1)).alias("n"), F.max(key()).alias("last")).where(F.col("n") >= ahead).groupBy("qid").agg(F.min("last").alias("last"))
        full = now.where(F.col("place") == limit).select("qid", key().alias("least"))
        unsettled = cut_lineage(behind.join(full, "qid", "left").where(F.col("least").isNull() | (F.col("least") > F.col("last"))).select("qid"))
        if unsettled.isEmpty():
            return now if merged is None else merged.unionByName(now)
        done = now.join(unsettled, "qid", "left_anti")
        merged, left, ahead = done if merged is None else merged.unionByName(done), unsettled, 8 * ahead


def _best_index_checks(claims: DataFrame, index: DataFrame, most: int) -> DataFrame:
    """The best ``most`` links of each claim, as ``merge_checks`` ranks them, by number q of the claim's terms and sense: qid, q, part, pos, url, classe, shared.

    A link stands for its newest check about the claim.
    """
    senses = (F.lit(False), F.lit(True), F.lit(None).cast("boolean"))
    of = lambda sense: verdicts.sense_guarded(F.col("class"), F.col("negated"), sense)
    read = _read_checks(index).where(F.size("terms") > 0).withColumn("pos", -F.unix_seconds("published"))
    rows = numbered(
        read.select("id", "url", "pos", F.col("terms").alias("words"), urls.without_slash(F.col("url")).alias("key"), F.array(*map(of, senses)).alias("classes")),
        "o", F.col("pos").asc(), F.col("id").asc(),
    ).withColumn("ahead", F.transform("classes", lambda c: c != ""))
    known = claims.where(F.col("qid").isNotNull() & (F.size("terms") > 0))
    asked = known.select("qid", "terms").join(known.select("qid", F.when(F.col("negado").isNull(), 2).when(F.col("negado"), 1).otherwise(0).alias("sense")), "qid").distinct()
    asked = numbered(asked.select("qid", "sense", F.col("terms").alias("words"), F.least(F.lit(fv.MIN_SHARED_TERMS), F.size("terms")).alias("needed")), "q")
    pairs = shared_words(asked, rows, 1, most, (["q", "qid", "sense"], ["pos", "url", "classes"]), first_of_key=True)
    classed = pairs.withColumn("classe", F.try_element_at("classes", F.col("sense") + 1)).withColumn("part", F.lit(1))
    best = top_per_group(classed, ["q"], [(F.col("classe") == "").asc(), F.col("shared").desc(), F.col("pos").asc()], most)
    return best.select("qid", "q", "part", "pos", "url", "classe", "shared")


def merge_checks(lists: DataFrame, limit: int = 5) -> DataFrame:
    """Checks with a verdict first, then by shared terms; each link once (first list wins); the best five per claim.

    ``lists``: qid, part, pos, url, classe, shared and any other columns.
    """
    order = [F.col("part").asc(), F.col("pos").asc()]
    unique = first_per_group(lists.withColumn("link", urls.without_slash(F.col("url"))), ["qid", "link"], order)
    ranking = [(F.col("classe") == "").asc(), F.col("shared").desc(), *order]
    return top_per_group(unique, ["qid"], ranking, limit, rank="place").drop("link")


def search_terms(query: str) -> list[str]:
    """Words of two letters or more of a typed query."""
    return list(dict.fromkeys(t for t in text.plain_fold(query).split() if len(t) > 1))


def _has_all(folded: Column, terms: list[str]) -> Column:
    out = F.lit(True)
    for term in terms:
        out = out & F.contains(folded, F.lit(term))
    return out


def keyword_search(index: DataFrame, query: str, kind: str | None = None, person: str | None = None) -> DataFrame:
    """Every term must occur; two points in the title, one in outlet or description. One pass over the index.

    ``index``: id, title, source_name, desc, kind, published, pessoas.
    """
    terms = search_terms(query)
    if not terms and not person:
        return index.select("id", F.lit(0).alias("score"), "published").where(F.lit(False))
    rows = index
    if kind:
        rows = rows.where(F.col("kind") == kind)
    if person:
        rows = rows.where(F.array_contains("pessoas", person))
    title = text.fold_grouping(F.col("title"))
    rest = text.fold_grouping(F.concat_ws(" ", "source_name", F.coalesce("desc", F.lit(""))))
    found = rows.withColumn("k_title", title).withColumn("k_rest", rest)
    points = F.lit(0)
    for term in terms:
        found = found.where(F.contains("k_title", F.lit(term)) | F.contains("k_rest", F.lit(term)))
        points = points + F.when(F.contains("k_title", F.lit(term)), 2).otherwise(1)
    return found.select("id", points.alias("score"), "published").orderBy(F.col("score").desc(), F.col("published").desc(), "id")


def type_ahead(index: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """The newest rows whose title and outlet contain all terms."""
    folded = text.fold_grouping(F.concat_ws(" ", "title", "source_name"))
    hits = index.where(_has_all(folded, search_terms(query)) & F.lit(bool(search_terms(query))))
    return hits.orderBy(F.col("published").desc(), F.col("id").asc()).limit(limit).select("id", "published")


def filter_stories(stories: DataFrame, query: str) -> DataFrame:
    """Stories whose title, summary, outlets and headlines together contain all terms. ``stories``: story, words."""
    return stories.where(_has_all(text.fold_grouping(F.col("words")), search_terms(query)))
