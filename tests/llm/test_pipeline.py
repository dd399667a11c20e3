"""The pipeline against brute force and against its operators, over awkward rows, and the registration."""

import hashlib
import os
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tidemark.llm import countmin, decontamination, simhash, substring_dedup, suffix_dedup, toxicity
from tidemark.llm.common import read, stored

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = read(spark, SF, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "substring_dedup", "decontamination", "sentencepiece"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stored(stage(spark, docs, SF), "stage")
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        before = {r.doc_id: r for r in docs.collect()}
        if k < 4:
            assert set(out.columns) == set(docs.columns) and dict(out.dtypes) == dict(docs.dtypes)
        if k == 0:
            bad = {r.doc_id for r in toxicity.score(docs, toxicity.train(docs, read(spark, SF, "labels"))).where("predicted = 1").collect()}
            assert ids == set(before) - bad
        if k == 1:
            assert ids == {r.component_id for r in simhash.near_duplicates(docs).collect()}
        if k == 2:
            found = {r.doc_id: r for r in substring_dedup.dedup(docs).collect()}
            assert ids == {i for i, r in found.items() if r.n_removed == 0 or r.n_removed < r.n_words}
            for r in out.collect():
                f = found[r.doc_id]
                assert r.text == (f.kept if f.n_removed else before[r.doc_id].text)
        if k == 3:
            assert ids == set(before) - {r.doc_id for r in decontamination.contaminated(docs, read(spark, SF, "benchmark")).collect()}
        docs = out
    assert ids == set(before) and len(ids) > 100


def overlaps(text, items):
    """Whether 0.8 of a window of an item stands in the text, place by place."""
    a = decontamination.tokens((text or "").encode())
    for x in items:
        b = decontamination.tokens((x or "").encode())
        n = min(13, len(b))
        if n < 5 or len(a) < n:
            continue
        at = {w: i for i, w in enumerate(dict.fromkeys(a + b))}
        p, q = (np.lib.stride_tricks.sliding_window_view(np.array([at[w] for w in y]), n) for y in (a, b))
        if any(((p == w).sum(1) >= decontamination.needed(n)).any() for w in q):
            return True
    return False


def test_run_is_brute_force(spark):
    import sentencepiece

    from tidemark.llm import queries

    from test_text import brute_fingerprint, components, words

    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    model = toxicity.train(docs, labels)
    rows = {r.doc_id: r.text for r in docs.collect()}
    rows = {i: t for i, t in rows.items() if model.score((t or "").encode()) < toxicity.THRESHOLD}
    ids = sorted(rows)
    kept = set(components([brute_fingerprint(rows[i]) for i in ids], ids))
    rows, first = {i: rows[i] for i in ids if i in kept}, {}
    for i in sorted(rows, reverse=True):
        w = words(rows[i])
        first |= {tuple(w[k : k + 13]): i for k in range(len(w) - 12)}
    for i in list(rows):
        w, gone = words(rows[i]), set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        if gone:
            rows[i] = " ".join(x for k, x in enumerate(w) if k not in gone)
            if len(gone) == len(w):
                del rows[i]
    items = [r.text for r in read(spark, SF, "benchmark").collect()]
    rows = {i: t for i, t in rows.items() if not overlaps(t, items)}
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.model_path())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {}
    for i, t in rows.items():
        code = sp.encode(t or "", add_bos=True, add_eos=True)
        want[i] = (len(code), sha(np.array(code, "<u4").tobytes()), sha(sp.decode(code).encode()))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and len(got) > 100


def test_stages_take_awkward_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, fp long, score double"
    long_text = " ".join(f"w{i % 700}x{i % 13}" for i in range(20_000))
    texts = [(1, "some plain words of a text that nobody minds"), (1, "some plain words of a text that nobody minds"), (2, None), (3, ""), (None, "a text without an id that is like no other one here"), (None, None), (4, long_text), (1, "quite another text that has the id of the first one")]
    full = spark.createDataFrame([(i, t, None, "s", None, "r", 7, 0.5) for i, t in texts], schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, full, SF).toPandas()
        if name != "sentencepiece":
            assert list(out.columns) == ["doc_id", "text", "lang", "source", "n_chars"], name
        want = {"simhash_near_dedup": 5}.get(name, len(texts))  # one of each: the first, none at all, without an id, long, another under 1
        assert len(out) <= want if name == "toxicity" else len(out) == want, (name, len(out))  # a model of these few rows may say anything
        assert stage(spark, full.limit(0), SF).count() == 0, name


def python_steps(node, above=0):
    """Most Python steps that one task of a plan has."""
    name, children = node.nodeName(), node.children()
    here = 0 if "Exchange" in name else above + name.startswith(("MapIn", "ArrowEval", "BatchEval", "FlatMap"))
    return max([here, *[python_steps(children.apply(i), here) for i in range(children.size())]])


def test_no_task_has_two_python_steps(spark, monkeypatch):
    """Two would be two Python workers at once for each core. Spark keeps them and takes turns among them, and each holds its own sketch."""
    seen = {}

    def checked(df, name):
        seen[name] = max(seen.get(name, 0), python_steps(df._jdf.queryExecution().executedPlan()))
        return stored(df, name)

    for module in (corpus_pipeline, countmin, decontamination, simhash, substring_dedup, suffix_dedup):
        monkeypatch.setattr(module, "stored", checked)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else plans don't show their steps until they have run
    try:
        checked(corpus_pipeline.run(spark, SF), "pipeline")
        docs = read(spark, SF, "documents").limit(40)
        checked(substring_dedup.dedup(docs, broadcast_bytes=0), "substring_dedup, sketch dealt")
        checked(suffix_dedup.dedup(docs, broadcast_bytes=0), "suffix_dedup, sketch dealt")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert {"toxicity", "simhash_near_dedup", "substring_dedup", "decontamination", "pipeline", "sketch", "runs"} <= set(seen)
    assert set(seen.values()) <= {0, 1}, seen


def test_registered():
    q = __spark_entry__.queries()
    assert {int(n[2:].split("_")[0]) for n in q if n.startswith("op") and n[2].isdigit()} == set(range(1, 14)) and "pipeline" in q
    assert set(__spark_entry__.oracle_sql()) <= set(q)


def test_shuffle_files_go_once_a_step_is_stored(spark):
    files = lambda: {n for n in re.findall(r"shuffle_\d+_\d+_\d+\.data", str(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()))}
    before = files()
    out = stored(spark.range(10_000).repartition(4, "id").groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false" and sorted(r["count"] for r in out.collect())[0] == 1428


@pytest.mark.parametrize("dealt", [False, True])
def test_substring_dedup_holds_little_at_once(spark, monkeypatch, dealt):
    """When texts are dealt, only the runs to cut are still stored; a sketch that is not broadcast meets its windows in turns."""
    steps, found = [], {}

    def kept(df, name):
        out = stored(df, name)
        steps.append((name, out.stored_at.removeprefix("file://")))
        if name == "runs":
            rows = {(r.anchor, r.sig) for r in out.where("kind = 1").select("anchor", "sig").collect()}
            assert not rows & found.get(name, set())
            found[name] = found.get(name, set()) | rows
        return out

    monkeypatch.setattr(substring_dedup, "stored", kept)
    monkeypatch.setattr(countmin, "stored", kept)
    substring_dedup.dedup(read(spark, SF, "documents").limit(300), **({"broadcast_bytes": 0} if dealt else {}))
    assert [name for name, _ in steps].count("runs") == (substring_dedup.TURNS if dealt else 1) and found["runs"]
    assert [name for name, path in steps if os.path.exists(path)] == ["cut"]
