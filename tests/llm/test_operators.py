"""Each operator against brute force on small tables, with nulls, empties, repeats and odd columns."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparsela.llm import chat, decontamination, exchange, jaccard_join, language_id, lm_scoring, packing, quality_model, quality_rules, text, token_counts, tokens, toxicity

SPLIT = text.WS.decode()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(t, lower=False):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "") if lower else t or ""
    for c in SPLIT:
        t = t.replace(c, " ")
    return [w for w in t.split(" ") if w]


@pytest.fixture(scope="module")
def texts():
    r = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(60)] + ["é", "naïve", "ok,"]
    base = [" ".join(r.choice(vocab, 60)) for _ in range(12)]
    near = []
    for b in base[:4]:
        for _ in range(4):
            w = b.split(" ")
            w[int(r.integers(60))] = "changed"
            near.append(" ".join(w))
    shared = " ".join(r.choice(vocab, 40))
    passages = [f"{shared} {' '.join(r.choice(vocab, 30))}" for _ in range(6)]
    odd = [None, "", " \n\t ", "one", "ONE", "two words", "two  words", base[0].upper(), base[0], base[0], "日本語 テキスト", "x" * 5000, "a\x0bb\x0cc\rd", " ".join(["same"] * 300), "nbsp word"]
    return [*base, *near, *passages, *odd, " ".join(base) * 3]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def clash(docs):
    """Columns whose names operators use inside."""
    return docs.withColumns({c: F.lit(1) for c in ("id", "block", "a", "v", "_text", "score", "part", "rep")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_words_match_the_plain_split(texts):
    w = text.Words(pa.array(texts))
    for i, t in enumerate(texts):
        assert [w.uniq[c].decode() for c in w.codes[w.off[i] : w.off[i + 1]]] == words(t)


def test_packed_keys_round_trip():
    r = np.random.default_rng(0)
    for k in (np.empty(0, np.uint64), np.unique(r.integers(0, 2**63, 1000).astype(np.uint64)), np.unique(r.integers(0, 2**20, 1000).astype(np.uint64))):
        assert (exchange.unpack_keys(exchange.pack_keys(k)) == k).all()
    for c in (np.array([1, 255]), np.array([1, 70_000]), np.array([1, 2**40])):
        assert (exchange.unpack_counts(exchange.pack_counts(c)) == c).all()


def test_components(spark):
    r = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 200, (150, 2))] + [(i, i + 1) for i in range(300, 340)] + [(500, k) for k in range(501, 560)]
    label = {}

    def root(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    got = {x["node"]: x["label"] for x in exchange.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: root(v) for e in edges for v in e if any(v in x and x[0] != x[1] for x in edges)}
    assert exchange.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_lm(texts, backoff=0.4, order=3):
    ws = [words(t) for t in texts]
    grams = lambda w, n: [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
    every = {n: Counter(g for w in ws for g in grams(w, n)) for n in range(1, order + 1)}
    total, out = sum(map(len, ws)), []
    for w in ws:
        own = {n: Counter(grams(w, n)) for n in range(1, order + 1)}
        c = lambda g: every[len(g)][g] - own[len(g)][g]
        s = 0.0
        for i in range(len(w)):
            full = min(i, order - 1)
            for n in range(full + 1, 0, -1):
                g = tuple(w[i - n + 1 : i + 1])
                if n == 1:
                    s += np.log((c(g) or backoff) / max(total - len(w), 1)) + full * np.log(backoff)
                elif c(g) > 0:
                    s += np.log(c(g) / c(g[:-1])) + (full - n + 1) * np.log(backoff)
                    break
        out.append((len(w), s))
    return out


def test_lm_scores(docs, clash, empty, texts):
    want = brute_lm(texts)
    for df in (docs, clash):
        got = by_id(lm_scoring.score(df))
        assert len(got) == len(texts)
        for i, (n, s) in enumerate(want):
            assert got[i]["n_words"] == n and abs(got[i]["log_score"] - s) < 1e-6
    assert lm_scoring.score(empty).count() == 0


def test_lm_keys_are_whole_hashes(monkeypatch):
    """n-grams whose hashes differ in the last bits only keep their own counts."""
    hashes = iter(range(1, 100, 10))
    monkeypatch.setattr(lm_scoring, "grams", lambda h, off, n: ((np.uint64(5 << 56) + np.arange(len(h) - n + 1).astype(np.uint64) + np.uint64(next(hashes))), off))
    packed = lm_scoring.packed_texts([pa.RecordBatch.from_pydict({"id": [1], "block": [0], "text": ["a b c"]})])
    keys, counts = lm_scoring.Block(pa.Table.from_batches(packed)).keys(0)
    assert len(keys) == 1 + 3 + 2 and counts.tolist() == [3] + [1] * 5


def test_lm_of_other_orders(docs, texts):
    for order in (2, 4):
        got = by_id(lm_scoring.score(docs, order=order))
        for i, (n, s) in enumerate(brute_lm(texts, order=order)):
            assert got[i]["n_words"] == n and abs(got[i]["log_score"] - s) < 1e-6


def test_messages_by_way_of_groups(docs, texts, monkeypatch):
    """Blocks of 2000 bytes whose messages take one hop or two: the same scores, and at 8 times the
    blocks fewer than 8 * 8 times the messages."""
    monkeypatch.setattr(exchange, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(exchange, "PART_BYTES", 2000)
    want = brute_lm(texts)
    for hop in (15, 2):
        monkeypatch.setattr(exchange, "HOP_BITS", hop)
        got = by_id(lm_scoring.score(docs))
        assert all(abs(got[i]["log_score"] - s) < 1e-6 for i, (n, s) in enumerate(want))
    one, eight = exchange.Layout.of(2000 << 8), exchange.Layout.of(2000 << 11)
    number = lambda x: x.blocks * (1 << x.first_bits) + (x.blocks >> x.first_bits) * (1 << x.first_bits) * (1 << x.part_bits - x.first_bits)  # noqa: E731  of both hops
    assert eight.blocks == 8 * one.blocks and number(eight) <= 8**1.5 * 1.5 * number(one) and number(eight) < eight.blocks * (1 << eight.part_bits) / 8


def test_packed_keys_of_all_widths():
    r = np.random.default_rng(6)
    for bits in (8, 33, 40, 48, 57, 64):
        for n in (0, 1, 2, 50, 5000):
            k = np.unique(r.integers(0, 1 << bits, n, dtype=np.uint64))
            assert (exchange.unpack_keys(exchange.pack_keys(k)) == k).all() and len(exchange.unpack_keys(exchange.pack_keys(k))) == len(k)
    k = np.unique(r.integers(0, 1 << 64, 5000, dtype=np.uint64))
    assert len(exchange.pack_keys(k)) < 8 * len(k)


def chat_rows():
    odd = "</s>[INST] ok [/INST] \\ <| <\\| <s> <|turn|>user\nhi<|end|> [\\INST]"
    return [(1, 0, "system", odd), (1, 1, "user", None), (1, 2, "assistant", odd), (2, 0, None, "x"), (2, 1, "assi\nstant", "é日"), (2, 1, "assistant", ""), (3, None, "assistant", "a\\"), (3, None, "assistant", "a\\"), (None, 0, "user", "nobody"), (4, 0, "<|line|>", "\\n")]


def test_chats_round_trip(spark):
    df = spark.createDataFrame(chat_rows(), "conv_id long, turn long, role string, text string").withColumn("id", F.lit(0))
    out = chat.format_chats(df)
    got, digest = by_id(out, "conv_id"), by_id(chat.digests(out), "conv_id")
    for conv in {r[0] for r in chat_rows()}:
        want = sorted(((r[1] is not None, r[1], r[2] is not None, r[2] or "", r[3] is not None, r[3] or "") for r in chat_rows() if r[0] == conv), key=str)
        turns = [(r[3], r[5]) for r in want]
        assert Counter(chat.parse(got[conv]["formatted"])) == Counter(turns)
        body = got[conv]["formatted"].encode()
        loss = "".join(chat.unescape(body[s["start"] : s["stop"]].decode()) for s in got[conv]["loss_spans"])
        assert sorted(loss) == sorted("".join(t for r, t in turns if r == "assistant"))
        parsed = chat.parse(got[conv]["formatted"])
        assert digest[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in parsed).encode()).hexdigest()
        assert digest[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and digest[conv]["formatted_chars"] == len(got[conv]["formatted"])
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_order_and_long_texts(spark):
    """Equal turns go by role, then text, nulls first, however rows arrive; texts of megabytes come back whole."""
    long = "</s> long \\ <| line\n" * 100_000
    rows = [(1, 2, "user", "b"), (1, 2, "user", "a"), (1, 2, "assistant", "z"), (1, 2, None, "n"), (1, 2, "user", None), (1, None, "user", "first"), (1, 1, "user", long), (1, 2, "user", "a")]
    want = [("user", "first"), ("user", long), ("", "n"), ("assistant", "z"), ("user", ""), ("user", "a"), ("user", "a"), ("user", "b")]
    for order in (rows, rows[::-1]):
        out = chat.format_chats(spark.createDataFrame(order, "conv_id long, turn long, role string, text string").repartition(3)).collect()
        assert len(out) == 1 and [tuple(t) for t in chat.parse(out[0]["formatted"])] == want and out[0]["n_turns"] == 8


def test_benchmark_of_many_blocks(spark):
    """Items dealt to forty blocks, with equal ids and texts among them: the same pairs as in one block."""
    r = np.random.default_rng(6)
    items = [(i % 70, " ".join(r.choice([f"b{k}" for k in range(500)], 12))) for i in range(80)]
    items += [items[0], (None, items[1][1])]
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(2)
    texts = [f"x y {items[3 * i][1]} z" for i in range(20)] + [" ".join(t for _, t in items[:30]), "none of them", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = Counter((d, i) for d, t in enumerate(texts) for i, b in items if len(shingles(t, 5) & shingles(b, 5)) >= np.ceil(0.8 * len(shingles(b, 5)) - 1e-9))
    for block in (200_000, 24):
        got = decontamination.find(df, bench, block_shingles=block)
        assert Counter((x["doc_id"], x["item_id"]) for x in got.collect()) == want and sum(want.values()) > 50
    assert {x["doc_id"] for x in decontamination.drop_matches(df, bench, block_shingles=24).collect()} == set(range(len(texts))) - {d for d, _ in want}


def test_decontamination(spark, docs, clash, empty, texts):
    items = [(0, texts[0]), (1, " ".join(words(texts[1])[10:40])), (2, None), (3, ""), (4, "TWO words"), (5, " ".join(words(texts[2])[:24] + ["zz"] * 6)), (6, "not there at all in them"), (6, texts[0])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = Counter()
    for d, t in enumerate(texts):
        for i, b in items:
            w, q = words(t, True), words(b, True)
            n = min(5, len(q))
            if n:
                a, s = ({tuple(v[k : k + n]) for k in range(len(v) - n + 1)} for v in (w, q))
                if len(a & s) >= max(1, np.ceil(0.8 * len(s) - 1e-9)):
                    want[d, i, len(s), len(a & s)] += 1
    assert want
    for df, block in ((docs, 200_000), (clash, 200_000), (docs, 1)):
        got = decontamination.find(df, bench, block_shingles=block).collect()
        assert Counter((r[0], r[1], r[2], r[3]) for r in got) == want
    kept = decontamination.drop_matches(clash, bench)
    assert kept.columns == clash.columns and {r["doc_id"] for r in kept.collect()} == set(range(len(texts))) - {k[0] for k in want}
    assert decontamination.find(empty, bench).count() == 0 and decontamination.find(docs, bench.limit(0)).count() == 0


def shingles(t, n):
    w = words(t, True)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute_components(texts, n=4, percent=85):
    sets = [shingles(t, n) for t in texts]
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            k = len(a & sets[j])
            if a and k and 100 * k >= percent * len(a | sets[j]) and label[i] != label[j]:
                lo, hi = sorted((label[i], label[j]))
                label = [lo if x == hi else x for x in label]
    return [(len(s), x) for s, x in zip(sets, label)]


def test_near_duplicates(docs, clash, empty, texts, monkeypatch):
    for df, percent, cell in ((docs, 85, jaccard_join.CELL_BYTES), (clash, 60, 512)):  # the second cuts every cell into blocks
        want = brute_components(texts, percent=percent)
        monkeypatch.setattr(jaccard_join, "CELL_BYTES", cell)
        got = by_id(jaccard_join.near_duplicates(df, percent=percent))
        assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == dict(enumerate(want))
    assert jaccard_join.near_duplicates(empty).count() == 0


def test_large_cells_in_rounds(spark, monkeypatch):
    """A chain of near copies whose ends have little in common, a bridge between two such groups, and
    a set that only shares its frequent part: small blocks must give the same components."""
    r = np.random.default_rng(8)
    words_ = [f"v{i}" for i in range(4000)]
    texts, at = [], 0
    for g in range(2):
        w = list(r.choice(words_, 80, replace=False))
        for i in range(40):
            w = list(w)
            w[(3 * i) % 80] = f"g{g}x{i}"
            texts.append(" ".join(w))
            if g == 1 and i == 0:
                half = texts[5].split(" ")[:40]
                texts.append(" ".join(half + w[40:]))
    want = brute_components(texts, percent=80)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(jaccard_join, "CELL_BYTES", 1500)
    got = by_id(jaccard_join.near_duplicates(df, percent=80))
    assert {i: (x["n_shingles"], x["component_id"]) for i, x in got.items()} == dict(enumerate(want))


def brute_links(texts, n=4, percent=85):
    sets = [shingles(t, n) for t in texts]
    return [sum(i != j and bool(a) and 100 * len(a & b) >= percent * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]


def test_every_link_is_counted(spark, texts, monkeypatch):
    """Copies, groups of near copies in one block and in pairs of blocks, sizes of several classes."""
    r = np.random.default_rng(3)
    w = [f"k{i}" for i in range(200)]
    group = [" ".join([*w[:i], "new", *w[i + 1 : 150 + 2 * i]]) for i in r.permutation(25).tolist()]
    every = [*texts, *group, *group[:3]]
    df = spark.createDataFrame(list(enumerate(every)), "doc_id long, text string").repartition(3)
    for percent, cell in ((85, jaccard_join.CELL_BYTES), (60, 2000)):
        monkeypatch.setattr(jaccard_join, "CELL_BYTES", cell)
        got = by_id(jaccard_join.near_duplicates(df, percent=percent))
        assert [got[i]["n_links"] for i in range(len(every))] == (want := brute_links(every, percent=percent)) and max(want) > 10
        few = by_id(jaccard_join.near_duplicates(df, percent=percent, links=False))
        assert {i: x["component_id"] for i, x in got.items()} == {i: x["component_id"] for i, x in few.items()}


def test_blocks_that_share_no_shingle_are_not_compared(spark, monkeypatch):
    """A ring of texts of which each shares runs with the next ones alone: one cell of many blocks, of
    which few pairs are compared; some neighbours are near copies."""
    runs = [" ".join(f"e{i}x{j}" for j in range(12)) for i in range(80)]
    texts = [" ".join(runs[(i + k) % 80] for k in range(4)) for i in range(80)]
    texts += [f"{t} tail{i}" for i, t in enumerate(texts) if i % 9 == 0]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(jaccard_join, "CELL_BYTES", 1200)
    seen, plain = [], jaccard_join._links
    monkeypatch.setattr(jaccard_join, "_links", lambda tasks, *a: seen.append(tasks.select("task", "p", "q").distinct().count() if "p" in tasks.columns else 0) or plain(tasks, *a))
    for links in (True, False):
        seen.clear()
        got = by_id(jaccard_join.near_duplicates(df, percent=80, links=links))
        assert {i: (x["n_shingles"], x["component_id"]) for i, x in got.items()} == dict(enumerate(brute_components(texts, percent=80)))
        blocks = 89 * 45 * 8 // 1200
        assert 0 < max(seen) < blocks * (blocks + 1) / 2 * 0.8
        assert not links or [x["n_links"] for _, x in sorted(got.items())] == brute_links(texts, percent=80)


def test_near_duplicates_of_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (1, "a b c d e"), (7, None)]
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r[0], r[2]) for r in got) == {(None, None): 1, (3, 1): 2, (1, 1): 1, (7, 7): 1}


def test_copies_of_a_hot_text(spark, monkeypatch):
    """A third of all rows are one text, others are null; near copies of it and repeated rows are there too."""
    base = " ".join(f"h{i}" for i in range(40))
    texts = [base] * 60 + [None] * 40 + [f"{base} t{i}" for i in range(6)] + [f"{base.upper()} "] * 3 + [f"other {i} text {i} of its own" for i in range(20)]
    rows = [*((i + 7, t) for i, t in enumerate(texts)), (7, base), (3, "other 1 text 1 of its own")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    plain = [t or "" for _, t in rows]
    label = [x for _, x in brute_components(plain)]
    least = {x: min(r[0] for r, y in zip(rows, label) if x == y) for x in label}
    want = Counter((r[0], least[x] if t else r[0], k) for r, t, x, k in zip(rows, plain, label, brute_links(plain)))
    for hot in (3, 1000):
        monkeypatch.setattr(jaccard_join, "HOT_ROWS", hot)
        monkeypatch.setattr(jaccard_join, "HOT_TEXTS", 1000)
        got = jaccard_join.near_duplicates(df).collect()
        assert Counter((r["doc_id"], r["component_id"], r["n_links"]) for r in got) == want
        few = jaccard_join.near_duplicates(df, links=False).collect()
        assert Counter((r["doc_id"], r["component_id"]) for r in few) == Counter((r["doc_id"], r["component_id"]) for r in got)


def test_search_finds_all_links():
    r = np.random.default_rng(2)
    for percent in (50, 85):
        sets = []
        for _ in range(12):
            base = r.choice(400, 60, replace=False)
            for _ in range(int(r.integers(1, 9))):
                s = base.copy()
                s[: int(r.integers(0, 12))] = r.integers(400, 2000)
                sets.append(np.unique(np.concatenate((s, r.integers(400, 2000, int(r.integers(0, 8)))))).astype(np.uint64))
        label = list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                k = len(np.intersect1d(sets[i], sets[j]))
                if 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                    lo, hi = sorted((label[i], label[j]))
                    label = [lo if x == hi else x for x in label]
        got = list(range(len(sets)))
        for i, j in jaccard_join.search(sets, percent):
            lo, hi = sorted((got[i], got[j]))
            got = [lo if x == hi else x for x in got]
        assert got == label


def test_quality_rules(spark, docs, clash, empty, texts):
    got = by_id(quality_rules.quality_rules(docs))
    for i, t in enumerate(texts):
        w, r = words(t), got[i]
        win = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        cover = {k + j for k in range(len(w) - 7) if win[tuple(w[k : k + 8])] > 1 for j in range(8)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), len(cover), len(lines) - len(set(lines)))
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in t or "")
        assert r["base_failed"] == (len(w) < 20 or 100 * len(cover) > 30 * len(w))
    assert quality_rules.quality_rules(clash).count() == len(texts) and quality_rules.quality_rules(empty).count() == 0


def test_frequent_lines_deplete(spark):
    own = lambda i, n: " ".join(f"u{i}x{j}" for j in range(n))
    common = " ".join(f"c{j}" for j in range(30))
    rows = [(i, f"{common}\n{own(i, 25 if i % 2 else 60)}", None, "h") for i in range(30)]
    rows += [(100, f"{common}\n{own(100, 25)}", None, "other"), (5, rows[5][1], None, "h"), (200, f"{common}\n{own(200, 25)}", None, None)]
    out = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    got = [(r["doc_id"], r["n_removed_words"], r["kept"]) for r in out.collect()]
    assert len(got) == len(rows) and got.count((5, 30, False)) == 2
    for i in range(30):
        assert (i, 30, i % 2 == 0) in got
    assert (100, 0, True) in got and (200, 0, True) in got


def test_copies_are_documents_of_a_line(spark):
    """Eleven copies of a text hold its lines in eleven documents; a repeated row adds none."""
    text_ = lambda g: "\n".join(" ".join(f"{g}{k}x{j}" for j in "abcdefghijklm") for k in "abc")
    rows = [(i, text_("p"), "h") for i in range(11)] + [(100 + i, text_("q"), "h") for i in range(10)] + [(100, text_("q"), "h"), (200, text_("p"), "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = by_id(quality_rules.quality_rules(df))
    assert all((got[i]["n_removed_words"], got[i]["kept"]) == (39, False) for i in range(11))
    assert all((got[i]["n_removed_words"], got[i]["kept"]) == (0, True) for i in (*range(100, 110), 200))
    assert all(r["kept"] and not r["n_removed_words"] for r in quality_rules.quality_rules(df, distinct_texts=True).collect())


def test_language(spark, empty):
    r = np.random.default_rng(0)
    pools = {"en": "the of and that with", "de": "der und nicht schön über", "fr": "le été où garçon avec", "es": "el niño que año está", "xx": "qzq zqx xqz"}
    rows = [(i * 10 + k, " ".join(r.choice(pools[g].split(), 30)), g, None, None) for k, g in enumerate(pools) for i in range(20)]
    df = spark.createDataFrame([*rows, (-1, None, "en", None, None), (-2, "12 34!", "en", None, None), (-3, "", None, None, None), (-4, "the of and", None, None, None), (-4, "the of and", None, None, None)], DOCS)
    m = language_id.train(df.where("doc_id % 3 != 0"))
    out = language_id.identify(df.withColumn("lang_pred", F.lit("zz")), m).collect()
    got = {x["doc_id"]: x["lang_pred"] for x in out}
    assert all(got[i] == g for i, _, g, *_ in rows) and [got[-k] for k in (1, 2, 3, 4)] == ["und", "und", "und", "en"]
    assert len(out) == len(rows) + 5 and all(0 <= x["score"] <= 1 for x in out)
    kept = language_id.keep_identified(df, m)
    assert kept.columns == df.columns and kept.count() == len(rows) + 2
    none = language_id.train(empty)
    assert {x["lang_pred"] for x in language_id.identify(df, none).collect()} == {"und"}


def slow_gram_counts(t):
    """Bytes as letters or blanks, 2- and 3-grams hashed one by one."""
    b, x = (t or "").encode(), np.zeros(2 * language_id.BUCKETS)
    fold = [c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in b]
    for i in range(1, len(b)):
        if b[i - 1] == 0xC3 and 0x80 <= b[i] <= 0x9E and b[i] != 0x97:
            fold[i] = b[i] + 32
    for k, n in enumerate((2, 3)):
        for i in range(len(fold) - n + 1):
            g = fold[i : i + n]
            if g[0] == 32 and g[-1] == 32:
                continue
            h = sum(c * m for c, m in zip(g, (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))) % 2**32
            h = (h ^ (h >> 15)) * 0x2C1B3C6D % 2**32
            x[k * language_id.BUCKETS + (h >> 21)] += 1
        half = slice(k * language_id.BUCKETS, (k + 1) * language_id.BUCKETS)
        x[half] /= max(x[half].sum(), 1)
    return x


def slow_language(m, t):
    """The family of the largest margin, then votes of its pairs; ties to the larger sum, then the first."""
    x = np.append(slow_gram_counts(t), 1)
    sure = lambda v: 1 / (1 + np.exp(-3 * v))
    if not any(c.isalpha() for c in t or ""):
        return "und", 0.0
    margin = [x @ w for w in m.family_w]
    f = int(np.argmax(margin))
    own = [g for g in m.langs if language_id.FAMILY_OF.get(g, g) == m.families[f]]
    votes, sums = Counter(), Counter()
    for (a, b), w in m.pairs.items():
        if a in own:
            v = x @ w
            votes[a if v > 0 else b] += 1
            sums[a] += v
            sums[b] -= v
    best = max(own, key=lambda g: (votes[g], sums[g]))
    return best, sure(margin[f]) * (sure(sums[best] / (len(own) - 1)) if len(own) > 1 else 1)


def test_language_against_brute_force(spark):
    r = np.random.default_rng(3)
    pools = {"en": "the of and that with", "de": "der UND nicht Schön über", "nl": "het een van zijn ook", "fr": "le été où garçon avec", "es": "el niño que año está", "xx": "qzq zqx xqz"}
    texts = [" ".join(r.choice(pools[g].split(), int(r.integers(1, 40)))) for g in pools for _ in range(25)]
    texts += [None, "", "12 ÷ 7", "ÀÉÎ×ÞØ x", "日本語", " ".join(r.choice("the der le el".split(), 30_000))]
    lang = [g for g in pools for _ in range(25)] + [None] * 6
    df = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(zip(texts, lang))], "doc_id long, text string, lang string").withColumns({c: F.lit(1) for c in ("id", "x", "h", "r", "rows")})
    m = language_id.train(df)
    got = by_id(language_id.identify(df, m))
    for i, t in enumerate(texts):
        g, s = slow_language(m, t)
        assert got[i]["lang_pred"] == g and abs(got[i]["score"] - s) < 1e-4, t
    for least in (None, 0.9):
        stay = {i for i, t in enumerate(texts) if (v := slow_language(m, t))[0] != "und" and (v[1] >= (least or m.least) or len(t.encode()) < 20)}
        kept = language_id.keep_identified(df, m, least=least)
        assert kept.columns == df.columns and {x["doc_id"] for x in kept.collect()} == stay


def test_svm_solves_its_problem():
    """At the optimum of the dual: inside 0 and c the margin is 1, at 0 it is above, at c below."""
    r = np.random.default_rng(1)
    x = (r.random((120, 30)) * (r.random((120, 30)) < 0.3)).astype(np.float32)
    y = np.where(x[:, :5].sum(1) > x[:, 5:10].sum(1), 1.0, -1.0)
    rows = language_id.Rows(language_id.pack_rows(x))
    assert (rows.dense(7, 50, 30) == x[7:50]).all()
    w = language_id.linear_svm(rows, np.arange(120), y, 30, 2.0, epochs=400)
    loss = lambda v: 0.5 * ((v[:-1] / 2) ** 2).sum() + 0.5 * v[-1] ** 2 + np.maximum(0, 1 - y * (x @ v[:-1] + v[-1])).sum()
    best = loss(w)
    assert all(loss(w + d) > best - 1e-2 for d in r.normal(0, 0.05, (200, 31)))


def test_sample_bounds_hold(spark, monkeypatch):
    """Rows without an id, of one id, and of one id and text: never more than the documented number."""
    size = []
    monkeypatch.setattr(language_id, "fit", lambda x, lang: size.append(Counter(lang)))
    one = spark.range(3000).selectExpr("cast(null as long) doc_id", "concat('the of ', id) text", "if(id % 3 = 0, 'en', 'de') lang")
    same = spark.range(3000).selectExpr("7L doc_id", "'the of' text", "'en' lang")
    for df in (one, one.selectExpr("7L doc_id", "text", "lang"), same):
        language_id.train(df, max_rows=20, per_language=12)
    language_id.train(one.selectExpr("doc_id", "text", "concat(lang, pmod(hash(text), 50)) lang"), max_rows=20, per_language=12)
    assert [sum(c.values()) for c in size] == [20, 20, 1, 20] and all(max(c.values()) <= 12 for c in size)
    labels = spark.createDataFrame([(7, 1), (7, 1), (8, 0), (None, 1)], "doc_id long, toxic int")
    docs = one.selectExpr("7L doc_id", "text")
    assert toxicity.sample_of(docs, labels, "doc_id", "toxic", 10, "text").count() == 10
    assert toxicity.sample_of(same, labels, "doc_id", "toxic", 10, "text").count() == 1


def slow_toxic_features(t):
    import xxhash

    strip = toxicity._PUNCT.decode()
    h = [xxhash.xxh64_intdigest((w.strip(strip) or w).encode()) for w in words(t, True)]
    pair = lambda a, b, k: int(text.split64(np.array([(a * (0x9E3779B97F4A7C15 + 2 * k) + b) % 2**64], np.uint64))[0])
    every = h + [pair(h[i], h[i + k], k) for k in (1, 2) for i in range(len(h) - k)]
    return {x >> (64 - toxicity.BITS) for x in every}


def slow_ftrl(rows, y, alpha=2.0, beta=1.0, l1=12.0, l2=1.0, epochs=10):
    """The update of each coordinate as published, one number at a time."""
    z, n, zb, nb = Counter(), Counter(), 0.0, 0.0
    weight = lambda z, n, l1: 0.0 if abs(z) <= l1 else -(z - np.sign(z) * l1) / ((beta + n**0.5) / alpha + l2)
    for _ in range(epochs):
        for x, t in zip(rows, y):
            w, b = {i: weight(z[i], n[i], l1) for i in x}, weight(zb, nb, 0.0)
            g = 1 / (1 + np.exp(-(sum(w.values()) + b))) - t
            for i in x:
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha * w[i]
                n[i] += g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / alpha * b
            nb += g * g
    return {i: v for i in z if (v := weight(z[i], n[i], l1))}, weight(zb, nb, 0.0)


def test_toxicity_against_brute_force(spark, texts):
    every = [*texts, "Idiot! you (idiot) ... -- you", " ".join(["long", "Words,"] * 20_000)]
    key, owner = toxicity.distinct(*toxicity.features(pa.array(every)))
    for i, t in enumerate(every):
        assert set(key[owner == i].tolist()) == slow_toxic_features(t)
    r = np.random.default_rng(9)
    y = (np.arange(200) % 3 == 0).astype(float)
    rows = [np.unique(np.concatenate((r.integers(0, 500, 20), [777] if t else [778]))) for t in y]
    w, bias = toxicity.ftrl(rows, y)
    want, b = slow_ftrl([x.tolist() for x in rows], y)
    assert set(np.flatnonzero(w).tolist()) == set(want) and want and abs(bias - b) < 1e-9 and all(abs(w[i] - v) < 1e-9 for i, v in want.items())
    at = np.array(sorted(slow_toxic_features(every[0]) | slow_toxic_features("idiot")))
    model = at, r.normal(size=len(at)), -0.3
    df = spark.createDataFrame(list(enumerate(every)), "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "score", "label", "h")})
    got, have = by_id(toxicity.score(df, model)), dict(zip(at.tolist(), model[1].tolist()))
    for i, t in enumerate(every):
        s = 1 / (1 + np.exp(-(sum(have.get(k, 0.0) for k in slow_toxic_features(t)) - 0.3)))
        assert abs(got[i]["score"] - s) < 1e-9 and got[i]["predicted"] == int(s >= 0.5)


def slow_quality(m, t):
    """Features of each passage by plain Python, gated attention passage by passage."""
    t = t or ""
    w, shape = words(t), []
    grams = [tuple(w[i : i + 4]) for i in range(len(w) - 3)]
    many = Counter(grams)
    at, spans = 0, []
    b = t.encode()
    for x in w:  # byte offsets
        at = b.index(x.encode(), at)
        spans.append(at)
        at += len(x.encode())
    for k in range(max(1, -(-len(w) // quality_model.PASSAGE_WORDS))):
        lo, hi = k * quality_model.PASSAGE_WORDS, min(len(w), (k + 1) * quality_model.PASSAGE_WORDS)
        x = np.zeros(quality_model.DIM)
        if hi > lo:
            body = b[spans[lo] : spans[hi] if hi < len(w) else len(b)]
            n, h = max(len(body), 1), quality_model.HIST
            for c in body:
                x[c >> 2] += 1 / n
            kinds = [b"#*$%&|<>", bytes(range(65, 91)), bytes(range(48, 58)), b"!?", b"\n"]
            x[h : h + 5] = [sum(c in kind for c in body) / n for kind in kinds]
            own = grams[lo : min(hi, len(grams))]
            x[h + 5 : h + 11] = [n / (hi - lo) / 10, np.log1p(hi - lo) / 5, np.log1p(len(w)) / 10, len(set(w[lo:hi])) / (hi - lo), sum(many[g] > 1 for g in own) / max(len(own), 1), sum(many[g] > 1 for g in grams) / max(len(grams), 1)]
        else:
            x[-1] = 1
        shape.append(x)
    p, sig = m.p, lambda v: 1 / (1 + np.exp(-v))
    hid = [np.tanh(np.clip((x - m.mean) / m.std, -8, 8) @ p["E"] + p["e"]) for x in shape]
    a = np.array([(np.tanh(v @ p["V"]) * sig(v @ p["U"])) @ p["a"] for v in hid])
    a = np.exp(a - a.max())
    return sig(sum(k * v for k, v in zip(a / a.sum(), hid)) @ p["w"] + p["b"][0]), len(shape)


def test_quality_against_brute_force(spark, texts):
    r = np.random.default_rng(2)
    every = [*[t for t in texts if t is None or "\xa0" not in t], " ".join(r.choice(["Alpha", "be###ta", "42", "gam\nma!", "é"], 3000))]
    m = quality_model.Model(r.random(quality_model.DIM) / 10, r.random(quality_model.DIM) + 0.1)
    df = spark.createDataFrame(list(enumerate(every)), "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "label", "x", "score", "h")})
    got = by_id(quality_model.score(df, m))
    for i, t in enumerate(every):
        s, n = slow_quality(m, t)
        assert got[i]["n_passages"] == n and abs(got[i]["score"] - s) < 1e-4, t
    kept = quality_model.keep_good(df, m, least=0.5)
    assert {x["doc_id"] for x in kept.collect()} == {i for i, x in got.items() if x["score"] >= 0.5} and kept.columns == df.columns


def labelled(spark, bad, good, label):
    r = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(300):
        y = i % 3 == 0
        w = list(r.choice([f"w{k}" for k in range(300)], int(r.integers(10, 250))))
        (bad if y else good)(w, r)
        rows.append((i, " ".join(w), "en", None, None))
        labels.append((i, int(y)))
    rows += [(1000, None, None, None, None), (1001, "", None, None, None), (1001, "", None, None, None), (1002, "x" * 3000, None, None, None)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame([*labels, (None, 1), (5, None)], f"doc_id long, {label} int")


def test_toxicity(spark, empty):
    df, labels = labelled(spark, lambda w, r: w.insert(int(r.integers(len(w))), "Idiot,"), lambda w, r: None, "toxic")
    m = toxicity.train(df, labels.where("doc_id % 5 != 0 or doc_id is null"))
    out = toxicity.score(df.withColumn("score", F.lit(2)), m).collect()
    got = {x["doc_id"]: x for x in out}
    right = [got[r[0]]["predicted"] == r[1] for r in labels.where("doc_id % 5 = 0 and toxic is not null").collect()]
    assert np.mean(right) > 0.95 and len(out) == 304
    assert all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.5) for x in out)
    assert toxicity.score(df, toxicity.train(empty, labels)).count() == 304 and toxicity.score(empty, m).count() == 0


def test_quality_model(spark, empty):
    def spoil(w, r):
        w[:] = [f"{x}***" if r.random() < 0.5 else x for x in w]

    df, labels = labelled(spark, spoil, lambda w, r: None, "quality")
    m = quality_model.train(df, labels.where("doc_id % 5 != 0"))
    out = quality_model.score(df.withColumn("n_passages", F.lit("x")), m).collect()
    got = {x["doc_id"]: x for x in out}
    right = [got[r[0]]["predicted"] == r[1] for r in labels.where("doc_id % 5 = 0 and quality is not null").collect()]
    assert np.mean(right) > 0.95 and len(out) == 304
    assert quality_model.score(df, quality_model.train(empty, labels)).count() == 304 and quality_model.score(empty, m).count() == 0
    assert quality_model.keep_good(df, m).columns == df.columns


def test_quality_gradient():
    r = np.random.default_rng(0)
    m = quality_model.Model(np.zeros(quality_model.DIM), np.ones(quality_model.DIM))
    x, off, y = r.normal(size=(7, quality_model.DIM)), np.array([0, 2, 3, 7]), np.array([1.0, 0, 1])
    loss = lambda: -np.mean([np.log(p if t else 1 - p) for p, t in zip(m.forward(x, off)[0], y)])
    g, h = m.gradient(x, off, y, 1.0), 1e-6
    for k in m.p:
        at = tuple(0 for _ in m.p[k].shape)
        m.p[k][at] += h
        up = loss()
        m.p[k][at] -= 2 * h
        down = loss()
        m.p[k][at] += h
        assert abs((up - down) / (2 * h) - g[k][at]) < 1e-6


def test_passages_do_not_depend_on_neighbours(texts):
    whole, off = quality_model.passages(pa.array(texts))
    for i, t in enumerate(texts):
        np.testing.assert_allclose(quality_model.passages(pa.array([t], pa.string()))[0], whole[off[i] : off[i + 1]], atol=1e-6)


ODD_TOKENS = ["", None, "  ", "a  \n b", "<|endoftext|> x<|endoftext|>", "　 \n　 x", "日本語 テキスト 123", "it's 's 'll  x\n\n\n y\t", "\x1c \x1d a", "é è́   k", " <| a", "Ünïcödé, ªº ½ ١٢", "😀😀 😀", "a" * 3000, "a   b c", "﻿x ​z", "don't DON'T", "\r\n \r\n"]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


def test_token_counts(spark, docs, clash, empty, texts):
    lib = library()
    ids = lambda t: lib.encode(t or "", add_special_tokens=False).ids
    df = spark.createDataFrame(list(enumerate(ODD_TOKENS)), "doc_id long, text string")
    for frame, every in ((df, ODD_TOKENS), (docs, texts), (clash, texts)):
        got = by_id(token_counts.count_tokens(frame, limit=100))
        for i, t in enumerate(every):
            n = len(ids(t))
            assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 100), t
    assert token_counts.count_tokens(empty).count() == 0


def test_whole_tokens_are_one_token():
    p, lib = tokens.default_path(), library()
    whole = tokens.whole_tokens(p)
    vocab = tokens.vocabulary(p)
    r = np.random.default_rng(0)
    pick = [s for s in r.permutation(np.array(sorted(whole), object))[:2000] if s.strip().isalpha() and s.isascii() and not s[1:].startswith(b" ")]
    assert pick and all(lib.encode(s.decode(), add_special_tokens=False).ids == [vocab[s]] for s in pick)


def test_strings_that_merges_do_not_reach(tmp_path):
    """'abcd' is in the vocabulary, but no merge makes it"""
    from tokenizers import Tokenizer, decoders, models, pre_tokenizers

    vocab = {c: b for b, c in tokens._byte_chars().items()} | {"ab": 256, "cd": 257, "abcd": 258}
    lib = Tokenizer(models.BPE(vocab, [("a", "b"), ("c", "d")]))
    lib.pre_tokenizer, lib.decoder = pre_tokenizers.ByteLevel(add_prefix_space=False), decoders.ByteLevel()
    lib.save(p := str(tmp_path / "made_up.json"))
    assert set(tokens.vocabulary(p)) - tokens.whole_tokens(p) == {b"abcd"}
    every = ["abcd", "xabcd abcd.", "ab cd", "abcd\n12 abcdé"]
    want = [lib.encode(t).ids for t in every]
    flat, off = tokens.encode(pa.array(every), p)
    assert [flat[a:b].tolist() for a, b in zip(off, off[1:])] == want
    assert tokens.count(pa.array(every), p)[0].tolist() == list(map(len, want))


def test_packing(spark, docs, clash, empty, texts):
    lib = library()
    df = spark.createDataFrame(list(enumerate(ODD_TOKENS + texts)), "doc_id long, text string").repartition(2)
    for frame, every in ((df, ODD_TOKENS + texts), (clash, texts)):
        rows = packing.pack(frame).collect()
        want = {i: [*lib.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(every)}
        seqs = {}
        for r in rows:
            got = np.frombuffer(r["ids"], "<u4").tolist()
            assert got == want[r["doc_id"]][r["start"] : r["start"] + r["length"]] and r["doc_tokens"] == len(want[r["doc_id"]])
            seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for i, w in want.items():
            at = 0
            for s, n in sorted((r["start"], r["length"]) for r in rows if r["doc_id"] == i):
                assert s == at
                at += n
            assert at == len(w)
        for pieces in seqs.values():
            at = 0
            for o, n in sorted(pieces):
                assert o == at
                at += n
            assert at <= 1024
    assert packing.pack(empty).count() == 0


def test_piece_classes():
    for n in range(1, 3000):
        owner, start, length = packing.pieces_of(np.array([n]), 1024, 24)
        assert length.sum() == n and (length > 0).all() and (start == np.cumsum(length) - length).all()


def test_padding_is_little(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack(df).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    full = sum(r["n"] if r["n"] & (r["n"] - 1) == 0 else 1024 for r in rows)
    assert 1 - sum(r["n"] for r in rows) / full < 0.02


def test_crc_column(spark):
    row = spark.range(1).select(text.crc_mod(F.lit(123), 4).alias("c")).first()
    assert row["c"] == zlib.crc32(b"123") % 4
