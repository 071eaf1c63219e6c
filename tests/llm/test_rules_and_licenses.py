"""Adaptive limits, measures and licence digests."""

from __future__ import annotations

import os
import re
from collections import Counter

from cases import SCHEMA, empty, frame, hard_rows, words
import random

from pyspark.sql import functions as F

from pressloom.llm import license_scan, quality_rules
from pressloom.llm.license_texts import KNOWN


def _measures(text):
    w = (text or "").encode().split()
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again)


def test_measures(spark):
    rows = hard_rows() + [(60, "a | b\na | b\n\n \na | b # c", "en", "a", 1)]
    got = quality_rules.judge(frame(spark, rows, clash=True)).collect()
    found = sorted(((str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got), key=str)
    expected = []
    for r in rows:
        m = _measures(r[1])
        expected.append((str(r[0]), *m, m[0] < 50 or 100 * m[4] > 50 * m[0]))
    assert found == sorted(expected, key=str)
    assert not any(r["kept"] for r in got if r["base_failed"])
    assert quality_rules.judge(empty(spark)).count() == 0


def test_limits_follow_the_group(spark):
    rng = random.Random(6)
    rows = []
    for i in range(900):
        group = i % 3
        own = [f"w{rng.randint(100000, 999999)}" for _ in range(120)]
        if group == 1:
            own = [w + " #" if k % 3 else w for k, w in enumerate(own)]  # marks are usual in this source
        rows.append((i, "\n".join(own), "en", f"s{group}", 1))
    rows += [(1000 + k, "\n".join(f"w{rng.randint(100000, 999999)} #" for _ in range(120)), "en", f"s{k}", 1) for k in range(2)]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not kept[1000] and kept[1001] and sum(kept[i] for i in range(900)) > 890


def test_sketch_quantiles(spark):
    rng = random.Random(7)
    values = sorted(rng.lognormvariate(0, 1) for _ in range(4000))
    rows = spark.createDataFrame([(x,) for x in values], "log_words double").select("*", *[F.col("log_words").alias(m) for m in quality_rules.MEASURES if m != "log_words"])
    measured = rows.select(F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"), F.lit(9).alias("n_words"), *quality_rules.MEASURES)
    limit = quality_rules.limits(quality_rules.sketches(measured)).where("level = 2 and measure = 'word_length'").first()
    q1, q3 = values[999], values[2999]
    assert abs(limit["low"] - (q1 - 3 * (q3 - q1))) < 0.1 and abs(limit["high"] - (q3 + 3 * (q3 - q1))) < 0.1


def test_license_forms(spark):
    mit = next(t for n, k, t in KNOWN if n == "MIT" and k == "text")
    worded = "MIT LICENCE\n\nCopyright (c) 2020 A. Person\n\n" + mit.replace("sublicense", "sub-license").replace('"', "''")
    rows = hard_rows() + [
        (70, worded, "en", "a", 1), (71, mit + " But not for you.", "en", "a", 1), (72, "text\nreleased under the MIT licence!\nmore\nLicensed under CC BY-NC 4.0.", "en", "a", 1),
        (73, "Released under the MIT License, mostly.", "en", "a", 1), (74, "Released under the MIT License.\nReleased under the MIT License.", "en", "a", 1),
    ]
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(frame(spark, rows, clash=True), license_scan.known_digests(spark)).collect()}
    assert got[70]["license"] == "MIT" and got[71]["license"] is None and got[73]["notices"] is None
    assert got[72]["notices"] == "CC-BY-NC-4.0,MIT" and got[72]["n_notice_lines"] == 2 and got[74]["n_notice_lines"] == 2
    assert license_scan.scan_licenses(empty(spark), license_scan.known_digests(spark)).count() == 0
    assert license_scan.scan_licenses(frame(spark, rows), license_scan.known_digests(spark)).count() == len(rows)


def test_full_texts_and_marked_copyright_lines(spark):
    folder = "/usr/share/common-licenses"
    mit = next(t for n, k, t in KNOWN if n == "MIT" and k == "text")
    marked = [f"{m} Copyright (c) 2020 A. Person\n{m}\n{m} {mit}" for m in ("#", "//", " *", ";;", "--")]
    rows = [(200 + i, t, "en", "a", 1) for i, t in enumerate(marked)] + [(210, "# Copyright (c) 2020 A. Person\n# no license", "en", "a", 1)]
    wanted = {200 + i: "MIT" for i in range(len(marked))} | {210: None}
    for i, (file, name) in enumerate([("Apache-2.0", "Apache-2.0"), ("GPL-2", "GPL-2.0"), ("GPL-3", "GPL-3.0"), ("LGPL-2.1", "LGPL-2.1"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0")]):
        if os.path.exists(f"{folder}/{file}"):
            text = open(f"{folder}/{file}").read()
            rows += [(220 + i, text, "en", "a", 1), (240 + i, "".join(f"# {line}\n" for line in text.split("\n")), "en", "a", 1)]
            wanted |= {220 + i: name, 240 + i: name}
    got = license_scan.scan_licenses(spark.createDataFrame(rows, SCHEMA), license_scan.known_digests(spark)).collect()
    assert {r["doc_id"]: r["license"] for r in got} == wanted
