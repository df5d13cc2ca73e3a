"""Each stage of the pipeline against brute force on what the stage before it kept, and the chain against the stages."""

import hashlib
import json
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from gridloom.llm.mixing import targets
from gridloom.llm.queries import tokenizer_path
from gridloom.llm.toxicity import fit, fold_remainder, score

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The small table with null ids and texts, one id over unrelated texts, copies, a long text and columns with clashing names."""
    at = str(tmp_path_factory.mktemp("pipeline"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = [r.text for r in docs.join(spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0 and quality = 1"), "doc_id").where("n_chars > 400").orderBy("doc_id").limit(6).collect()]
    new = [(None, clean[0] + " alpha"), (None, clean[1] + " beta"), (None, None), (-1, ""), (-2, clean[2]), (-2, clean[3]), (-2, clean[3]), (-3, clean[4].upper()), (-4, clean[4].lower()), (-5, " ".join(clean * 20))]
    extra = spark.createDataFrame([(i, t, None, "web") for i, t in new], "doc_id long, text string, lang string, source string")
    both = docs.unionByName(extra, allowMissingColumns=True).select("*", F.lit(7).alias("n_tokens"), F.lit("x").alias("size"), F.lit(1.5).alias("toxic_score"), F.lit(2).alias("rid"), F.col("lang").alias("kept"))
    both.write.parquet(f"{at}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{at}/labels.parquet")
    return at


@pytest.fixture(scope="module")
def steps(spark, folder):
    """Input and result of every stage."""
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, folder)
        made.write.parquet(f"{folder}/{name}")
        kept = spark.read.parquet(f"{folder}/{name}")
        out[name], docs = (docs, kept), kept
    return out


def rows(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_columns(steps):
    for name, (before, after) in steps.items():
        if name != "bpe_codec":
            assert after.columns == before.columns


def test_toxicity(spark, folder, steps):
    """What scores 0.5 or more goes and nothing else; ten positive labels are too few to know every toxic word, but clean texts stay."""
    docs, labels = steps["toxicity"][0], spark.read.parquet(f"{folder}/labels.parquet")
    scores = score(docs.select("doc_id", "text"), fit(docs, labels, fold_remainder(F.col("doc_id")) != 0))
    after = rows(steps["toxicity"][1])
    assert after == rows(scores.where("toxic_score < 0.5")) and after != rows(docs)
    toxic = {r.doc_id: r.toxic for r in labels.where("toxic is not null").collect()}
    gone = [i for i, _ in (rows(docs) - after).elements() if i in toxic]
    assert sum(toxic[i] == 0 for i in gone) <= 0.02 * sum(v == 0 for v in toxic.values())
    assert 2 * sum(toxic[i] == 1 for i in gone) >= sum(v == 1 for v in toxic.values())


def test_exact_dedup(steps):
    before, after = map(rows, steps["exact_dedup"])
    groups = {}
    for i, t in before.elements():
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    kept = {(t or "").translate(LOWER): i for i, t in after.elements()}
    assert sum(after.values()) == len(groups) and not after - before
    assert kept == {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}


def test_near_dedup(steps):
    before, after = map(rows, steps["near_dedup"])
    items, sets = list(before.elements()), []
    for _, t in items:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(items)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(items)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    parts = {}
    for k, item in enumerate(items):
        parts.setdefault(find(k), []).append(item)
    assert any(len(p) > 1 for p in parts.values())
    assert sum(after.values()) == len(parts) and not after - before
    lows = Counter(min((i for i, _ in p if i is not None), default=None) for p in parts.values())
    assert Counter(i for i, _ in after.elements()) == lows


def test_source_mix(steps):
    before, after = steps["source_mix"]
    size = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)")))
    words = {r.source: r.n for r in before.groupBy("source").agg(F.sum(size).alias("n")).collect()}
    taken = {r.source: r.n for r in after.groupBy("source").agg(F.sum(size).alias("n")).collect()}
    longest = {r.source: r.n for r in before.groupBy("source").agg(F.max(size).alias("n")).collect()}
    for s, goal in targets(words).items():
        assert abs(taken.get(s, 0) - goal) <= longest[s]
    a, b = rows(after), rows(before)
    assert all(n <= 2 * b[k] for k, n in a.items())


def test_bpe_codec(steps):
    before, after = steps["bpe_codec"]
    assert set(after.columns) == (set(before.columns) - {"text"}) | {"n_tokens", "token_ids", "decoded_sha256", "restored"}
    tok = Tokenizer.from_file(tokenizer_path())
    tok.no_padding(), tok.no_truncation()
    want = Counter()
    for r in before.collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        said = tok.decode(ids, skip_special_tokens=False)
        want[r.doc_id, r.source, r.rid, json.dumps(ids), hashlib.sha256(said.encode()).hexdigest(), said == (r.text or "")] += 1
    got = after.collect()
    assert Counter((r.doc_id, r.source, r.rid, json.dumps(r.token_ids), r.decoded_sha256, r.restored) for r in got) == want
    assert all(r.n_tokens == len(r.token_ids) for r in got)


def test_chain(spark, folder, steps):
    key = lambda r: (r.doc_id, r.source, r.decoded_sha256)
    assert Counter(map(key, corpus_pipeline.run(spark, folder).collect())) == Counter(map(key, steps["bpe_codec"][1].collect()))


def test_no_documents(spark, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0 if t == "documents" else 10**6).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
