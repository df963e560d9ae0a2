"""The pipeline's stages and its run as a whole against brute force in plain Python."""

import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from test_near_dedup import kept as near_kept

import corpus_pipeline
from tracebed.llm import mixing, quality, tokens
from tracebed.llm.common import MADE, written

SF = "/root/testdata/sf0.001"
SPACED, WORDS = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def passes(text, rules):
    """The base rule and the learned list, by their definitions."""
    w = SPACED.findall(text or "")
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = Counter(windows)
    repeats = {k for i, x in enumerate(windows) if count[x] > 1 for k in range(i, i + 5)}
    if len(w) < 10 or 100 * len(repeats) > 20 * len(w):
        return False
    lines = [x for x in (text or "").split("\n") if SPACED.search(x)]
    chars = sum(map(len, w))
    x = {
        "symbol_ratio": len(re.findall(r"[#*$%&|<>]", text)) / len(w), "dup_line_ratio": (len(lines) - len(set(lines))) / len(lines), "repeat_ratio": len(repeats) / len(w), "distinct_ratio": len(set(w)) / len(w),
        "word_length": chars / len(w), "capital_ratio": len(re.findall("[A-Z]", text)) / chars, "mark_ratio": len(re.findall("[.,;:!?]", text)) / len(w), "words": len(w),
    }
    return not any(all(x[n] <= at if side == "<=" else x[n] > at for n, side, at in rule) for rule in rules)


def dirty(text, items):
    w = WORDS.findall((text or "").translate(LOWER))
    return any(tuple(w[k : k + m]) in items for m in {len(x) for x in items} for k in range(len(w) - m + 1))


def windows_of(bench):
    out = set()
    for t in bench:
        w = WORDS.findall((t or "").translate(LOWER))
        out |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9) if w else 0)}
    return out


def mixed(rows):
    """doc_id, text of every row of the mix; rows: doc_id, text, source."""
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()), "source": pa.array([r[2] for r in rows], pa.string())}))
    taken = {}
    for i, size, n in con.execute(f"SELECT doc_id, size, taken FROM ({mixing.ORACLE})").fetchall():
        taken.setdefault((i, size), []).append(n)
    out = []
    for i, text, _ in rows:
        w = SPACED.findall(text or "")
        n = taken[i, len(w)].pop()
        out += [(i, text)] * (n // max(1, len(w)))
        if w and n % len(w):
            out.append((i, " ".join(w[: n % len(w)])))
    return out


def sharded(spark, rows):
    """slot, number and digest of the ids of each sequence."""
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("text", "xxhash64(doc_id, text) & 9223372036854775807 as key")
    with open(tokens.TOKENIZER, "rb") as f:
        encode = tokens.encoding(f.read()).encode_ordinary
    stream = [t for r in sorted(df.collect(), key=lambda r: r.key) for t in [*encode(r.text or ""), 50256]]
    parts = [stream[i : i + tokens.LENGTH] for i in range(0, len(stream), tokens.LENGTH)]
    slots = tokens.Permutation(len(parts), 42).slot(np.arange(len(parts))).tolist()
    return sorted((s, len(p), hashlib.sha256(np.array(p, np.uint16).tobytes()).hexdigest()) for s, p in zip(slots, parts, strict=True))


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder of tables with nulls, empty texts, ties, repeated rows and clashing names."""
    folder = tmp_path_factory.mktemp("odd")
    given = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    given += [(None, given[3][1], "en", None, 1), (None, None, None, None, None), (9001, None, "en", "s", 0), (9002, "", "en", None, 0), (9003, " \n", "en", "s", 2), given[5], given[5], (9004, "one two three " * 4000 + given[8][1], "en", "s", 9)]
    names = "doc_id bigint, text string, lang string, source string, n_chars bigint, __file int, __row int, size int, kept int, taken int, places int, node int"
    spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6, 7) for r in given], names).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").collect()] + [(None, 1), (9001, None)]
    spark.createDataFrame(labels, "doc_id bigint, quality int").write.parquet(f"{folder}/labels.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()] + [(None, None), (None, "...")]
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.mark.parametrize("which", ["given", "odd"])
def test_stages(spark, odd, which):
    sf = SF if which == "given" else odd
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    items = windows_of(r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect())
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        rows = [(r.doc_id, r.text, r.source) for r in before.collect()]
        docs = written(stage(spark, docs, sf), "stage")
        if name == "quality rules":
            rules = quality.train(before, spark.read.parquet(f"{sf}/labels.parquet"))
            expected = [r[:2] for r in rows if passes(r[1], rules)]
        elif name == "SimHash near-dedup":
            order = lambda i: (i is None, i or 0)
            stay = near_kept([(order(r[0]), r[1]) for r in rows])
            assert sorted(order(r.doc_id) for r in docs.collect()) == sorted(stay)
            continue
        elif name == "benchmark decontamination":
            expected = [r[:2] for r in rows if not dirty(r[1], items)]
        elif name == "mixing sources to target weights":
            expected = mixed(rows)
        else:
            found = sorted((r.slot, r.n_tokens, r.tokens_sha256) for r in docs.collect())
            assert found == sharded(spark, [r[:2] for r in rows])
            continue
        assert docs.columns == columns
        assert Counter((r.doc_id, r.text) for r in docs.collect()) == Counter(expected), name
        assert 0 < len(expected) and (len(expected) != len(rows) or name not in ("quality rules", "benchmark decontamination"))


def test_run_is_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    rules = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [r for r in rows if passes(r[1], rules)]
    stay = set(near_kept([r[:2] for r in rows]))
    items = windows_of(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect())
    rows = [r for r in rows if r[0] in stay and not dirty(r[1], items)]
    out = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.slot, r.n_tokens, r.tokens_sha256) for r in out) == sharded(spark, mixed(rows))


def test_an_empty_table(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    before = len(MADE)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert len(MADE) - before < 12  # tables of stages that are done are deleted
