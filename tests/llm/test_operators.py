"""Every operator against brute force, on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F

from tracebed.llm import blocks, chat, decontaminate, html, mixing, quality, simhash, suffixes, tokens, warc
from tracebed.llm.common import NULL_ID, written
from tracebed.llm.components import components

WORDS = [f"w{i}" for i in range(400)]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, chunk int, bucket string, size string, taken int, row int, node string, fp string, key int"


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def rows():
    base, shared = prose(1, 300), prose(2, 60)
    out = [
        (1, base, "s0"), (2, base, "s0"), (2, base, "s0"), (3, base.replace("w7 ", "x ", 1), "s1"), (4, prose(3, 50) + " " + shared + " " + prose(4, 50), None),
        (5, prose(5, 40) + "\n" + shared + "\t" + prose(6, 70), "s1"), (6, shared, "s2"), (7, None, "s0"), (8, "", "s2"), (9, " \n\t ", None), (None, shared + " end", "s0"), (None, None, None),
        (10, "one", "s3"), (11, "one two three four", "s3"), (12, "the " * 400, "s3"), (13, "é ü ñ " * 50, "s4"), (14, prose(7, 30000) + " " + shared + " " + prose(8, 200), "s0"),
        (15, "Alpha*** Beta$$$ " * 30, "s5"), (16, prose(9, 30) + "\n\nsame line\nsame line\n" + prose(10, 30), "s0"), (-3, shared, "s1"),
    ]
    return [(i, t, "en", s, len(t or ""), 7, "b", "z", 5, 1, "n", "f", 2) for i, t, s in out]


@pytest.fixture(scope="module")
def docs(spark):
    return written(spark.createDataFrame(rows(), SCHEMA).repartition(3), "docs")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def same(found, expected):
    assert Counter(map(tuple, found)) == Counter(map(tuple, expected))


def duck(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    return con.execute(sql).fetchall()


def sha(data):
    return hashlib.sha256(data).hexdigest()


# --- 1 -------------------------------------------------------------------------------------------------------------------


def test_mixing(docs, empty):
    columns = "doc_id, size, source_size, target, taken"
    found = mixing.mix(docs).selectExpr(*columns.split(", ")).collect()
    near = lambda r: (*r[:3], round(r[3], 6), r[4])
    same(map(near, found), map(near, duck(f"SELECT {columns} FROM ({mixing.ORACLE})", documents=docs)))
    for target, size in {(r.target, r.source_size) for r in found}:
        assert target <= 3 * size + 1e-6
    assert all(r.taken <= 3 * r["size"] for r in found)
    assert mixing.mix(empty).count() == 0 and mixing.materialise(empty).count() == 0


def test_mix_rows_hold_the_words_taken(docs):
    out = mixing.materialise(docs)
    assert out.columns == docs.columns
    by_source = Counter()
    for r in out.collect():
        by_source[r.source] += len(r.text.split())
    plan = Counter()
    for r in mixing.mix(docs).collect():
        plan[r.source] += r.taken
    assert by_source == +plan


# --- 2 -------------------------------------------------------------------------------------------------------------------


def brute_bytes(texts):
    count = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if count[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        yield len(t), int(gone.sum()), spans, sha(np.frombuffer(t, np.uint8)[~gone].tobytes())


@pytest.mark.parametrize("group", [suffixes.GROUP, 1])
def test_suffixes(docs, empty, group, monkeypatch):
    monkeypatch.setattr(suffixes, "GROUP", group)
    given = docs.select("doc_id", "text").collect()
    expected = brute_bytes([(r.text or "").encode() for r in given])
    same(suffixes.dedup_bytes(docs).collect(), [(r.doc_id, *e) for r, e in zip(given, expected, strict=True)])
    assert suffixes.dedup_bytes(empty).count() == 0


def test_transform():
    rng = random.Random(1)
    for _ in range(150):
        need = rng.choice([2, 3, 5, 8])
        texts = [bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(1, 8))]
        count = Counter(t[i : i + need] for t in texts for i in range(len(t) - need + 1))
        assert [x.tolist() for x in suffixes.repeated(texts, need)] == [[count[t[i : i + need]] > 1 for i in range(max(0, len(t) - need + 1))] for t in texts]


def brute_apart(texts, need):
    """By sorting all suffixes: whether each shares fewer than `need` bytes with the one above."""
    rows = sorted((t[i:], k, i) for k, t in enumerate(texts) for i in range(len(t)))
    shared = lambda x, y: next((n for n, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y)))
    return sum(shared(x[0], y[0]) >= need for x, y in zip(rows, rows[1:], strict=False))


def test_intervals_find_every_common_prefix():
    rng = random.Random(9)
    for _ in range(100):
        need = rng.choice([2, 3, 5])
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 6))]
        lengths = np.array([len(t) for t in texts])
        raw = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        stop = np.cumsum(lengths + 1) - 1
        symbols = raw.astype(np.int64) + 1
        symbols[stop] = 0
        order = suffixes.suffix_array(symbols, np.repeat(stop, lengths + 1) - np.arange(len(raw)), int(lengths.max()) + 1)
        apart = suffixes.expand_intervals(symbols[order - 1].astype(np.uint16), len(texts), need)
        assert int((~apart).sum()) == brute_apart(texts, need)


def thue_morse(n):
    return "".join("ab"[i.bit_count() % 2] for i in range(n))


@pytest.mark.parametrize("n", [512, 1024, 4096])
def test_long_words_that_polynomials_take_for_equal(spark, n):
    word = thue_morse(n)
    other = word.translate(str.maketrans("ab", "ba"))
    start = prose(40, 12)
    df = spark.createDataFrame([(1, f"{start} {word}"), (2, f"{start} {other}"), (3, f"{start} {word}")], "doc_id bigint, text string")
    assert {r.doc_id: r.n_removed for r in blocks.dedup_words(df).collect()} == {1: 0, 2: 0, 3: 13}
    removed = {r.doc_id: r.n_removed for r in suffixes.dedup_bytes(df).collect()}
    texts = [f"{start} {x}".encode() for x in (word, other, word)]
    assert [removed[i] for i in (1, 2, 3)] == [x[1] for x in brute_bytes(texts)]


def test_chunks_share_partitions(spark, docs, monkeypatch):
    """More chunks and buckets than partitions give the same rows."""
    from tracebed.llm import packed

    expected = [{tuple(r) for r in f(docs).collect()} for f in (blocks.dedup_words, suffixes.dedup_bytes)]
    monkeypatch.setattr(packed, "CHUNK_BYTES", 512)
    monkeypatch.setattr(packed, "PARTITIONS", 3)
    assert packed.chunked(docs)[1] > 3
    assert [{tuple(r) for r in f(docs).collect()} for f in (blocks.dedup_words, suffixes.dedup_bytes)] == expected


# --- 3 -------------------------------------------------------------------------------------------------------------------


def test_chat(spark):
    hard = chat.HARD
    given = [(1, 1, "user", "hi"), (1, 2, "assistant", hard), (1, 2, "assistant", hard), (1, None, "sys:tem", "a\\b"), (2, 0, None, None), (2, 1, "assistant", None), (None, 0, "user", "<x>"), (3, 0, "assistant", "y" * 200_000 + "\\")]
    df = spark.createDataFrame([(*r, "z") for r in given], "conv_id bigint, turn bigint, role string, text string, messages string")
    found = {r.conv_id: r for r in chat.formatted(df).collect()}
    columns = "conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars"
    expected = [r for r in duck(f"SELECT {columns} FROM ({chat.ORACLE})", conversations=df) if r[0] != -7]
    same(found.values(), expected)
    assert chat.formatted(df.where("false")).count() == 0


def test_chat_escapes_are_reversible():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(["\\", "#", "<", "/turn>", "\n", ":", " ", "### Assistant: ", "a"]) for _ in range(12))
        out, reader = [], chat.Reader()
        for event in chat.compiled(chat.TEMPLATE, chat.FILTERS)({"messages": [{"role": text, "text": text}, {"role": "assistant", "text": text}]}):
            reader.feed(event)
            out.append(event)
        assert reader.row(1)[1:4] == (2, sha(f"{text}\n{text}\nassistant\n{text}\n".encode()), len(text))


def test_template_language():
    from tracebed.llm.template import Text, TemplateError, compiled, fold, parse

    filters = {"up": str.upper}
    show = lambda source, **env: "".join(x for x in compiled(source, filters)(env) if isinstance(x, str))
    assert show("{% for x in xs %}{{ x.a | up }}{% if x.a == 'b' %}!{% elif x.a in 'cd' %}?{% else %}.{% endif %}{% endfor %}", xs=[{"a": "b"}, {"a": "c"}, {"a": "z"}]) == "B!C?Z."
    assert show("{% set y = 'a' + x %}{{ y if x else 'none' }} {#- gone -#} {{ not x }}{{ not x or none }}", x="b") == "abfalse"
    assert fold(parse("a{{ 'b' | up }}{% if 1 == 1 %}c{% else %}{{ x }}{% endif %}{% if false %}d{% endif %}"), filters) == (Text("aBc"),)
    assert show("{{ x.__class__ }}", x="s") == ""
    for bad in ("{% for x in y %}", "{{ f(x) }}", "{{ x | nothing }}", "{{ }}", "{% import os %}", "{{ x %}"):
        with pytest.raises(TemplateError):
            compiled(bad, filters)


# --- 4 -------------------------------------------------------------------------------------------------------------------


def test_warc(spark):
    page = "<p>" + "é" * 200
    given = [(3, "http://a/ü\r\nX: y", page), (1, "http://b", page), (None, None, page), (1, "http://b", page), (4, "u", "short"), (2, "u", "short"), (5, "u", None), (6, "u", ""), (7, "u", "x" * 500_000)]
    df = spark.createDataFrame([(*r, "d") for r in given], "page_id bigint, url string, html string, digest string").repartition(3)
    found = warc.read(warc.write(df)).collect()
    columns = "page_id, payload_bytes, payload_digest, record_type, refers_to"
    expected = [r if r[0] is not None else (None, r[1], r[2], "revisit", 1) for r in duck(f"SELECT {columns} FROM ({warc.ORACLE})", pages=df)]
    same(found, expected)
    assert warc.read(warc.write(df.where("false"))).count() == 0


def test_warc_reader_finds_damage():
    import io

    data = warc.record(1, "u", b"hello" * 50, sha(b"hello" * 50), None) + warc.record(2, "u", b"hello" * 50, sha(b"hello" * 50), 1)
    assert [h["warc-type"] for h, *_ in warc.records(io.BytesIO(data))] == ["response", "revisit"]
    assert next(warc.records(io.BytesIO(data)))[4] == b"hello" * 50
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(data[:-20])))
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(warc.record(1, "u", b"hello", sha(b"other"), None))))


# --- 5 -------------------------------------------------------------------------------------------------------------------


def test_blocks(docs, empty):
    given = docs.select("doc_id", "text").collect()
    words = [(r.text or "").encode().split() for r in given]
    ids = [NULL_ID if r.doc_id is None else r.doc_id for r in given]
    least = {}
    for i, w in zip(ids, words, strict=True):
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            least[key] = min(least.get(key, i), i)
    expected = []
    for r, i, w in zip(given, ids, words, strict=True):
        gone = set()
        for k in range(len(w) - 12):
            if least[tuple(w[k : k + 13])] < i:
                gone.update(range(k, k + 13))
        expected.append((r.doc_id, len(w), len(gone), sha(b" ".join(x for k, x in enumerate(w) if k not in gone))))
    same(blocks.dedup_words(docs).collect(), expected)
    assert blocks.dedup_words(empty).count() == 0


# --- 6 -------------------------------------------------------------------------------------------------------------------


def test_quality_statistics(docs, empty):
    expected = []
    for r in docs.select("doc_id", "text").collect():
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        count, covered = Counter(windows), set()
        for i, x in enumerate(windows):
            if count[x] > 1:
                covered.update(range(i, i + 5))
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        expected.append((r.doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    same(quality.statistics(docs).select(*columns).collect(), expected)
    assert quality.statistics(empty).count() == 0


def test_quality_learns_thresholds(spark):
    rng = random.Random(3)
    good = [(i, prose(i, rng.randint(50, 200)), 1) for i in range(200)]
    poor = [(1000 + i, " ".join(w + "***" for w in prose(1000 + i, 80).split()), 0) for i in range(60)]
    df = spark.createDataFrame([r[:2] for r in good + poor], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in good + poor if r[0] % 2] + [(None, 0), (5, None)], "doc_id bigint, quality int")
    rules = quality.train(df, labels)
    out = {r.doc_id: r.kept for r in quality.judged(quality.statistics(df), rules).collect()}
    assert rules and all(out[r[0]] == bool(r[2]) for r in good + poor)  # half of them were not labelled
    kept = quality.kept(df, labels)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in good}
    assert quality.train(df, labels.where("false")) == [] and quality.train(df.where("false"), labels) == []


def test_quality_verdict_by_brute_force(spark, docs):
    """Rules, and the columns they name, by plain Python; clashing columns stay."""
    rules = [[("symbol_ratio", ">", 0.25)], [("words", "<=", 60.0), ("distinct_ratio", ">", 0.9)]]
    stats = quality.measured(quality.statistics(docs)).collect()
    expected = []
    for r in stats:
        failed = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
        symbols, distinct = (r.n_symbols / r.n_words, r.n_distinct / r.n_words) if r.n_words else (0, 0)
        expected.append((r.doc_id, failed, not failed and not symbols > 0.25 and not (r.n_words <= 60 and distinct > 0.9)))
    same(quality.judged(quality.statistics(docs), rules).select("doc_id", "base_failed", "kept").collect(), expected)
    clash = docs.withColumn("kept", F.lit("mine")).withColumn("__at", F.lit(1)).withColumn("poor", F.lit(2))
    labels = spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")
    assert quality.kept(clash, labels).columns == clash.columns and {r.kept for r in quality.kept(clash, labels).collect()} == {"mine"}


# --- 7 -------------------------------------------------------------------------------------------------------------------


def test_decontamination(spark, docs, empty, monkeypatch):
    shared = prose(2, 60).upper()
    items = [(1, shared), (2, " ".join(prose(2, 60).split()[20:33])), (3, "one"), (4, "é ü"), (5, None), (6, "..."), (7, prose(77, 30)), (None, "four"), (3, "one")]
    bench = spark.createDataFrame([(*r, 1) for r in items], "item_id bigint, text string, doc_id int")
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: re.findall(pattern, (t or "").translate(lower))
    windows = {}
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add("" if i is None else str(i))
    expected, clean = [], []
    for r in docs.collect():
        w, hit, names = split(r.text), set(), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                if (own := windows.get(tuple(w[k : k + m]))) is not None:
                    hit.update(range(k, k + m))
                    names |= own
        expected.append((r.doc_id, len(w), len(hit), len(names), sha(",".join(sorted(names)).encode()), bool(hit)))
        if not hit:
            clean.append(r)
    for bits in (decontaminate.FILTER_BITS, 4):  # a filter that is full changes nothing
        monkeypatch.setattr(decontaminate, "FILTER_BITS", bits)
        same(decontaminate.contamination(docs, bench).collect(), expected)
        same(decontaminate.clean(docs, bench).collect(), clean)
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(docs, bench.where("false")).where("contaminated").count() == 0


# --- 8 -------------------------------------------------------------------------------------------------------------------

LONG = "A sentence of the article with a good number of words in it, so that it counts as text. "


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        (f"<body><nav><a>m</a></nav><article><h1>T</h1><p>{LONG}<p>short<br>one</article><footer>f</footer>", f"T\n\n{LONG.strip()}\n\nshort one"),
        (f"<header><h1>Site</h1></header><div class=post><h2>T &lt;1&gt;</h2><p>{LONG}</p><p>x</p></div><div id='comments'><p>{LONG}{LONG}</p></div><aside>{LONG}</aside>", f"T <1>\n\n{LONG.strip()}\n\nx"),
        (f"<main><p>{LONG}</p><form>{LONG}</form><div class='cookie-notice'>{LONG}</div><script>var p='<p>';</script><p>end</main>", f"{LONG.strip()}\n\nend"),
        (f"<article><p>{LONG}</p></article><article class='comment'><p>{LONG}{LONG}</p></article>", LONG.strip()),
        ("<nav>only a menu</nav>", ""),
        (f"<p class=ad>buy<p>{LONG}<ul><li>one<li>two</ul>", f"{LONG.strip()}\n\none\n\ntwo"),
        (f"<div hidden>{LONG}</div><div style='display: none'>{LONG}</div><p>{LONG}", LONG.strip()),
    ],
)
def test_main_text(page, text):
    assert html.main_text(page) == text


def test_html_rows(spark):
    df = spark.createDataFrame([(1, "u", "<p>a  b", "x"), (1, "u", "<p>a  b", "x"), (None, None, None, None), (2, "v", "<p>" + "long " * 100_000, "x")], "page_id bigint, url string, html string, text string")
    same([(r.page_id, r.url, r.n_chars) for r in html.extracted(df).collect()], [(1, "u", 3), (1, "u", 3), (None, None, 0), (2, "v", 499_999)])
    assert html.extracted(df.where("false")).count() == 0


# --- 9 -------------------------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    nodes = list(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("hot", [simhash.HOT, 1])
def test_simhash(spark, docs, empty, hot, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", hot)
    given = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()]
    root = groups({f for _, f in given}, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for i, f in given:
        if i is not None:
            least[root[f]] = min(least.get(root[f], i), i)
    found = simhash.linked(docs).selectExpr("doc_id", "lower(lpad(hex(fp), 16, '0'))", "component_id").collect()
    same(found, [(i, f"{f:016x}", least.get(root[f])) for i, f in given])
    assert simhash.linked(empty).count() == 0


@pytest.mark.parametrize("hot", [simhash.HOT, 1])
def test_links_lose_nothing(spark, hot, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = random.Random(4)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for f in list(fps)[:30]:
        for _ in range(6):
            f ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            fps.add(f)
    fps |= {0, 1, 2**63, 2**64 - 1}
    signed = lambda f: f - 2**64 if f >= 2**63 else f
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp bigint")
    root = {r.node: r.root for r in components(simhash.links(df)).collect()}
    expected = groups(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    got = {f: root.get(signed(f), signed(f)) for f in fps}
    assert len(set(got.values())) == len(set(expected.values())) == len({(got[f], expected[f]) for f in fps})


def test_chains_drop_candidates_before_distances():
    """Fingerprints that agree in two segments and are random elsewhere: nearly all go by one segment's bits."""
    rng, fps = np.random.default_rng(1), []
    pair = simhash.PAIRS.index((0, 2))
    fixed = np.uint64(simhash.segment(0) | simhash.segment(2))
    base = rng.integers(0, 2**64, dtype=np.uint64)
    other = rng.integers(0, 2**64, 400, dtype=np.uint64)
    fps = np.unique((base & fixed) | (other & ~fixed))
    fps = np.unique(np.concatenate((fps, fps[:40] ^ np.uint64(1 << 20))))  # of segment 1
    left, seen = np.arange(len(fps))[::-1], []
    a, b = simhash.near(fps, np.full(len(fps), pair), left, seen)
    candidates, chained, linked = np.sum(seen, axis=0)
    assert candidates == len(fps) * (len(fps) - 1) // 2 and linked == len(a) >= 40
    assert linked <= chained < candidates / 100
    two, seen = fps[:2], []
    simhash.near(two, np.full(2, pair), np.array([1, 0]), seen)  # groups of two ask the chain as well
    assert [s[0] for s in seen] == [1]
    for x in range(len(a)):
        assert (int(fps[a[x]]) ^ int(fps[b[x]])).bit_count() <= 2


def test_chains_keep_every_pair_within_two_bits():
    for i in range(64):
        for k in range(i, 64):
            x = np.array([1 << i | 1 << k], np.uint64)
            kept = [simhash.chained(x, np.array([p]))[0] for p, (s, t) in enumerate(simhash.PAIRS) if not int(x[0]) & (simhash.segment(s) | simhash.segment(t))]
            assert any(kept)


def test_links_refuse_other_limits(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp bigint"), 3)


@pytest.mark.parametrize("few", [1 << 20, 0])
def test_components(spark, few, monkeypatch):
    monkeypatch.setattr("tracebed.llm.components.FEW", few)
    path = [(i, i + 1) for i in range(1, 200)] + [(500, 400 + k) for k in range(50)] + [(7, 7)]
    random.Random(5).shuffle(path)
    root = {r.node: r.root for r in components(spark.createDataFrame(path, "a bigint, b bigint")).collect()}
    assert all(root[i] == 1 for i in range(2, 201)) and all(root[i] == 400 for i in [*range(401, 450), 500])
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_near_copies(spark, docs, empty):
    rng, given = random.Random(6), []
    for k in range(20):
        words = prose(100 + k, 300).split()
        given.append((10 * k, " ".join(words)))
        given.append((10 * k + 1, " ".join(words)))
        for c in range(2, 5):
            near = list(words)
            for i in rng.sample(range(300), 3):  # similarity of 0.9 and more
                near[i] = "edited"
            given.append((10 * k + c, " ".join(near)))
    df = spark.createDataFrame(given, "doc_id bigint, text string")
    assert sorted(r.doc_id for r in simhash.one_of_each(df).collect()) == [10 * k for k in range(20)]
    left = simhash.one_of_each(docs)
    assert left.columns == docs.columns and {1, 4, 5, 6, 10, 11} >= {r.doc_id for r in left.collect() if r.doc_id in (1, 2, 6)}
    assert sum(r.doc_id == 2 for r in left.collect()) == 0  # copies of 1, one of them twice
    assert simhash.one_of_each(empty).count() == 0


# --- 10 ------------------------------------------------------------------------------------------------------------------


def test_permutation():
    for n in (1, 2, 3, 5, 16, 17, 1000, 4097):
        order = tokens.Permutation(n, 7)
        slots = order.slot(np.arange(n))
        assert sorted(slots.tolist()) == list(range(n))
        assert (order.sequence(slots) == np.arange(n)).all()
    assert (tokens.Permutation(1000, 1).slot(np.arange(1000)) != tokens.Permutation(1000, 2).slot(np.arange(1000))).any()


def test_shards_do_not_depend_on_splits(spark, docs):
    """The same rows in other files and buckets make the same shards; they hold the texts in the order of their hashes."""
    found = []
    for n, each in ((1, 16 << 20), (7, 1000)):
        tokens_ = written(docs.repartition(n), "splits")
        before, tokens.BUCKET_BYTES = tokens.BUCKET_BYTES, each
        try:
            manifest, order = tokens.shards(tokens_, length=128, per_shard=64)
        finally:
            tokens.BUCKET_BYTES = before
        found.append(sorted((r.shard, r.slots, r.sha256) for r in manifest.collect()))
    assert found[0] == found[1] and len(found[0]) > 1
    slots = np.concatenate([np.stack(list(tokens.records(r.path, 128))) for r in sorted(manifest.collect(), key=lambda r: r.shard)])
    stream = slots[order.slot(np.arange(order.n))].reshape(-1)
    with open(tokens.TOKENIZER, "rb") as f:
        encode = tokens.encoding(f.read()).encode_ordinary
    hashed = docs.selectExpr("xxhash64(doc_id, text) & 9223372036854775807 as key", "text").collect()
    expected = [t for r in sorted(hashed, key=lambda r: r.key) for t in [*encode(r.text or ""), 50256]]
    assert stream[stream != tokens.PAD].tolist() == expected


def test_a_megabyte_without_spaces(spark):
    df = spark.createDataFrame([(1, "ab" * 500_000), (2, "x")], "doc_id bigint, text string")
    out = tokens.read(*tokens.shards(df)).collect()
    with open(tokens.TOKENIZER, "rb") as f:
        n = len(tokens.encoding(f.read()).encode_ordinary("ab" * 500_000))
    assert sum(r.n_tokens for r in out) == n + 3


def test_token_shards(docs, empty, monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK", 1000)
    monkeypatch.setattr(tokens, "FLUSH", 5000)
    manifest, order = tokens.shards(docs, length=128, per_shard=64)
    with open(tokens.TOKENIZER, "rb") as f:
        encoding = tokens.encoding(f.read())
    expected = Counter(tuple(encoding.encode_ordinary(r.text or "")) for r in docs.collect())
    by_slot = {}
    for r in manifest.collect():
        for i, a in enumerate(tokens.records(r.path, 128)):
            by_slot[r.shard * 64 + i] = a
        assert (next(tokens.records(r.path, 128, start=r.slots - 1)) == by_slot[r.shard * 64 + r.slots - 1]).all()  # resumed
    assert sorted(by_slot) == list(range(order.n))
    stream = np.concatenate([by_slot[s] for s in order.slot(np.arange(order.n)).tolist()])
    stream = stream[stream != tokens.PAD]
    texts, begin = Counter(), 0
    for end in np.flatnonzero(stream == 50256):
        texts[tuple(stream[begin:end].tolist())] += 1
        begin = end + 1
    assert texts == expected and begin == len(stream)
    found = tokens.read(manifest, order, 128, 64).collect()
    assert sorted(r.slot for r in found) == list(range(order.n)) and sum(r.n_tokens for r in found) == len(stream)
    assert all(r.tokens_sha256 == sha((a := by_slot[r.slot])[a != tokens.PAD].tobytes()) and r.sequence == order.sequence(np.array([r.slot]))[0] for r in found)
    assert tokens.read(*tokens.shards(empty)).count() == 0
