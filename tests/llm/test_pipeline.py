"""The pipeline against plain versions of its stages, and the tables' SQL."""

import re

import corpus_pipeline
import duckdb
import public_tokenizers

from folioquarry.llm import byte_bpe, queries, quality_lines, secret_scan

SF = "/root/testdata/sf0.001"


def test_run(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    verdict = quality_lines.judge(quality_lines.default_model(), list(docs.values()))["kept"]
    left = [i for i, k in zip(docs, verdict, strict=True) if k]
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i in left if (w := docs[i].split())}
    root = {i: i for i in left}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in left:
        for j in left:
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    left = [i for i in left if find(i) == i]
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    grams = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = split(r.text)
        grams |= {tuple(w[j : j + 10]) for j in range(len(w) - 9)}
    left = [i for i in left if not any(tuple(w[j : j + 10]) in grams for w in [split(docs[i])] for j in range(len(w) - 9))]
    codec = byte_bpe.Codec(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    want = {}
    for i, (a, b) in zip(left, secret_scan.find([docs[i] for i in left]), strict=True):
        text, at, out = docs[i], 0, []
        for x, y, _ in sorted(a + b):
            if x >= at:
                out += [text[at:x], "[SECRET]"]
            at = max(at, y)
        want[i] = codec.encode("".join(out) + text[at:])
    got = {r.doc_id: list(r.token_ids) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want


def test_stages_keep_columns_and_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.collect() == []


def test_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark", "pages"):
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, SF)
        cur = con.execute(sql)
        at = [[c[0] for c in cur.description].index(c) for c in df.columns]
        assert sorted(map(repr, map(tuple, df.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in cur.fetchall()), name


def test_stages_on_nulls_repeats_and_clashing_columns(spark):
    bench = " ".join(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").limit(1).collect())
    prose = " ".join(f"Word{i % 37} and then more of it." for i in range(30))
    other = prose.replace("Word", "Term") * 3
    rows = [(1, prose + " one two three four five six", None), (1, prose + " " + bench, "s"), (2, None, "s"), (None, prose.upper(), "s"), (None, None, None), (3, "", "s"), (4, other + " token = \"c1e4c9030b2fad02edf9e9b50afc6bbc838394ff\" end", "s"), (4, other + " token = \"c1e4c9030b2fad02edf9e9b50afc6bbc838394ff\" end", "s"), (5, "x " * 90_000, "s")]
    schema = "doc_id long, text string, source string, __clean string, clean int, kept int, KEPT2 int, id string, w int, fp long, n_hit int, gone_id string, gone_raw long, gone_hash int, own_raw int"
    docs = spark.createDataFrame([(*r, "c", 1, 2, 3, "i", 4, 5, 6, "g", 7, 8, 9) for r in rows], schema)
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        left[name] = out.collect()
    assert [(r.doc_id, r["__clean"], r.clean, r.kept) for r in left["secret scan"]] == [(i, "c", 1, 2) for i, _, _ in rows]
    assert [r.text for r in left["secret scan"] if r.doc_id == 4] == [other + " [SECRET]\" end"] * 2
    assert sorted((r.doc_id or 0, len(r.text or "")) for r in left["decontamination"]) == sorted((i or 0, len(t or "")) for i, t, _ in rows if t is None or bench not in t)
    assert sorted((r.doc_id or 0) for r in left["near duplicates"]) == [0, 0, 1, 1, 2, 3, 4, 5]
    assert not [r for r in left["quality rules"] if not r.text]
    assert corpus_pipeline.encode(spark, docs, SF).count() == len(rows)
