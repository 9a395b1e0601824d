"""The training-data operators against brute force, round trips and their libraries, on small and awkward tables."""

import hashlib
import itertools
import math
import random
import string
import re
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

import corpus_pipeline
from parchment.llm import chunked_encoding, common, decontaminate, line_dedup, mixing, near_docs, quality_lm, quality_rules, sharding, simhash, suffix_dedup, token_counts, token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string, id string, h string, key string, words string, part string, before string, fp string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    """rows: (doc_id, text, lang, source); the other columns have names that operators use inside."""
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *"abcdefghi") for r in rows], SCHEMA).repartition(3)


def prose(rng, n, vocab=200):
    return " ".join(f"w{int(vocab * rng.random() ** 2)}" + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randint(0, 120)), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "hot", "hot", None])) for i in range(n)]
    base = prose(rng, 90)
    rows += [(100 + i, base, "en", "hot") for i in range(12)]  # copies
    words = base.split()
    for i in range(8):  # near copies
        w = list(words)
        w[rng.randrange(len(w))] = f"x{i}"
        rows.append((200 + i, " ".join(w), "en", "a"))
    rows += [(300, None, "en", "a"), (301, "", "en", None), (302, "  \n\t ", None, "b"), (303, "one", "xx", "b"), (304, "A b\x0bc", "en", "a"), (305, "é" * 500, "fr", "a")]
    rows += [(306, "long " + prose(rng, 30_000, 5000), "en", "b"), (307, "a\nb\na\n\nb", "en", "c"), (308, "x" * 5000, "en", "c")]
    rows += [rows[3], rows[3], (None, rows[4][1], None, None), (None, None, None, None)]
    return rows


def got(df, key="doc_id"):
    out = defaultdict(list)
    for r in df.collect():
        out[r[key]].append(r.asDict())
    return out


def union_find(nodes, edges):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_prefix_sum_and_components(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.randrange(50), i) for i in range(300)]
    out = common.prefix_sum(spark.createDataFrame(rows, "g string, v long, i long"), "g", ["v", "i"], "v", "sum").collect()
    for g in "ab":
        total = 0
        for r in sorted((r for r in out if r.g == g), key=lambda r: (r.v, r.i)):
            assert r["sum"] == total
            total += r.v
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)]
    found = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = union_find({x for e in edges for x in e}, edges)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert found == {n: c for n, c in want.items() if n in linked}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def removed_by_force(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        out.append(gone)
    return out


@pytest.mark.parametrize("length, gram, cap", [(40, 10, 10**6), (40, 10, 3), (25, 25, 10**6)])
def test_suffix_dedup(spark, length, gram, cap):
    rng = random.Random(length)
    passage = prose(rng, 20)
    rows = corpus(2, 30) + [(400 + i, prose(rng, 5) + " " + passage[: 30 + 5 * i] + " " + prose(rng, 5), "en", "a") for i in range(10)]
    rows += [(500, "ab" * 60, "en", "a"), (501, "ab" * 10, "en", "a"), (502, "q" * 39, "en", "a")]
    rows = [r for r in rows if r[0] != 306] + [(306, prose(rng, 2000, 5000), "en", "b")]
    out = got(suffix_dedup.remove_repeats(frame(spark, rows), length, gram=gram, cap=cap))
    texts = [(r[1] or "").encode() for r in rows]
    for r, t, gone in zip(rows, texts, removed_by_force(texts, length), strict=True):
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        want = {"doc_id": r[0], "n_bytes": len(t), "n_removed": sum(gone), "n_spans": runs, "kept_sha256": hashlib.sha256(kept).hexdigest()}
        assert want in out[r[0]], (r[0], out[r[0]], want)


def test_suffix_dedup_pieces(spark, monkeypatch):
    """Texts longer than a piece: anchors are the same wherever the cut falls."""
    rng = random.Random(9)
    t = bytes(rng.randrange(97, 101) for _ in range(3000))
    whole = [(int(f + b), int(n + b), int(a + b), int(h)) for _, _, base, first, last, at, hs in suffix_dedup.anchors([t], 40, 10) for b, f, n, a, h in zip(base, first, last, at, hs, strict=True)]
    monkeypatch.setattr(suffix_dedup, "PIECE", 500)
    cut = [(int(f + b), int(n + b), int(a + b), int(h)) for _, _, base, first, last, at, hs in suffix_dedup.anchors([t], 40, 10) for b, f, n, a, h in zip(base, first, last, at, hs, strict=True)]
    spread = lambda rows: {(s, a, h) for f, n, a, h in rows for s in range(f, n + 1)}
    assert spread(whole) == spread(cut) and len(spread(cut)) == 3000 - 39


def test_sharding(spark):
    rows = corpus()
    out = sharding.bin_pack(frame(spark, rows), 8).collect()
    assert len(out) == len(rows)
    by_text, sizes, slots = defaultdict(set), Counter(), defaultdict(list)
    texts = defaultdict(set)
    for i, t, *_ in rows:
        texts[i].add((t or "").encode())
    for r in out:
        assert any(r.size == len(t) + 1 and r.text_crc32 == zlib.crc32(t) for t in texts[r.doc_id])
        by_text[r.text_crc32, r.size].add(r.shard)
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
        assert (r.law, r.grown_shard) == ("bytes", None)
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.bin_pack(frame(spark, []), 8).count() == 0
    rng = random.Random(5)
    many = sorted(Counter(rng.randrange(1, 1000) for _ in range(3000)).items(), reverse=True)
    total, count, whole = Counter(), Counter(), sum(s * n for s, n in many)
    for size, b, n in sharding.pack(many, 8):
        total[b] += size * n
        count[size] += n
    assert count == dict(many) and set(total) == set(range(8)) and max(total.values()) - min(total.values()) < 0.01 * whole
    hot = sharding.pack([(whole, 2), *many], 8)
    assert {b for _, b, _ in hot} == set(range(8)) and [x for x in hot if x[0] == whole] == [(whole, 0, 1), (whole, 1, 1)]
    assert sharding.pack([], 8) == [] and sharding.pack([(5, 2)], 8) == [(5, 0, 1), (5, 1, 1)]


def test_best_fit_is_tightest():
    rng = random.Random(8)
    sizes = sorted((rng.randrange(1, 60) for _ in range(300)), reverse=True)
    left, want = [], []
    for s in sizes:
        fits = [(r, i) for i, r in enumerate(left) if r >= s]
        if not fits:
            left.append(100)
            fits = [(100, len(left) - 1)]
        i = min(fits)[1]
        left[i] -= s
        want.append((s, i))
    placed = Counter()
    for s, i, n in sharding.best_fit_decreasing(sorted(Counter(sizes).items(), reverse=True), 100):
        placed[s, i] += n
    assert placed == Counter(want)


def test_token_counts_and_files(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    rows = corpus() + [(600 + i, t, "en", "a") for i, t in enumerate(("<|endoftext|> a<|endoftext|>", "don't  it's\n\n x", " lead", "tab\tand  two ", "中文 텍스트 123", "a" * 3000))]
    ids = [library.encode(r[1] or "", add_special_tokens=False).ids for r in rows]
    want = sorted((str(r[0]), len((r[1] or "").encode()), len(x), len(x) > 1024) for r, x in zip(rows, ids, strict=True))
    out = token_counts.token_counts(frame(spark, rows), PATH).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in out) == want
    assert token_counts.token_counts(frame(spark, []), PATH).count() == 0
    path = common.shared_path(spark, "test")
    token_files.write_token_files(frame(spark, rows), path, PATH)
    out = sorted(token_files.token_digests(spark, path).collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == Counter((r[0], len(x) + 1, zlib.crc32(array("I", [*x, 0]).tobytes())) for r, x in zip(rows, ids, strict=True))
    assert [r.start for r in out] == [sum(q.n_tokens for q in out[:i]) for i in range(len(out))]
    assert [r.doc_id for r in out if r.doc_id is not None] == sorted(r.doc_id for r in out if r.doc_id is not None)
    one = token_files.read_tokens(spark, path, "doc_id = 601").first()
    assert one.ids == library.encode(rows[-5][1], add_special_tokens=False).ids + [0]
    assert sorted(r.start for r in token_files.read_index(spark, path).collect()) == [r.start for r in out]
    token_files.write_token_files(frame(spark, rows), path + "-delta", PATH, dictionary=False)
    assert token_files.token_digests(spark, path + "-delta").count() == len(rows)
    # rows of one id, in the order of the files
    same = [(1, "word " * k, "en", "a") for k in (51, 6, 2)] + [(2, "x", "en", "a")]
    token_files.write_token_files(frame(spark, same), path + "-same", PATH)
    order = [r.n_tokens for r in sorted(spark.read.parquet(path + "-same").collect(), key=lambda r: (r.part, r.row))]
    assert [r.n_tokens for r in sorted(token_files.token_digests(spark, path + "-same").collect(), key=lambda r: r.start)] == order


def test_token_file_layout(spark):
    """Row groups, page indexes and encodings are as asked for, and a filter on the id reads few pages."""
    import glob

    import pyarrow.parquet as pq

    rng = random.Random(62)
    rows = [(i, prose(rng, 200, 3000), "en", "a") for i in range(1600)]
    for dictionary in (True, False):
        path = common.shared_path(spark, "layout")
        token_files.write_token_files(frame(spark, rows), path, PATH, dictionary=dictionary, row_group_bytes=128 << 10, page_bytes=16 << 10, partitions=2)
        files = [pq.ParquetFile(f) for f in glob.glob(path.removeprefix("file:") + "/part-*.parquet")]
        assert len(files) == 2 and all(f.metadata.num_row_groups > 1 for f in files)
        for f in files:
            for g in range(f.metadata.num_row_groups):
                group = f.metadata.row_group(g)
                columns = {group.column(k).path_in_schema.split(".")[0]: group.column(k) for k in range(group.num_columns)}
                assert all(c.has_offset_index and c.has_column_index for name, c in columns.items())
                found = set(columns["ids"].encodings)
                assert any("DICTIONARY" in e for e in found) if dictionary else any("DELTA" in e for e in found)
        plan = token_files.read_tokens(spark, path, "doc_id = 7")._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)]" in plan and token_files.read_tokens(spark, path, "doc_id = 7").count() == 1
        index = token_files.read_index(spark, path)._jdf.queryExecution().executedPlan().toString()
        assert "ids:array" not in index
    assert token_files.token_files(frame(spark, []), PATH).count() == 0


def test_chunks_equal_whole_texts():
    from tokenizers import Tokenizer

    rng, library = random.Random(5), Tokenizer.from_file(PATH)
    alphabet = [*"ab Éñß1 2.,'s  \n\t_ 　中\x1c\x85!-", "<|endoftext|>", " it's", "don't ", " 'll", "word ", "élan, "]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    encoder = chunked_encoding.ChunkEncoder(PATH, list, lambda parts: [x for p in parts for x in p])
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert encoder.folded(texts) == want
    for t in texts[:500]:
        cut = list(chunked_encoding.blocks(t, 10))
        whole = [" " + b if spaced else b for spaced, b in cut]
        assert "".join(whole) == t and [i for b in whole for i in library.encode(b, add_special_tokens=False).ids] == library.encode(t, add_special_tokens=False).ids
    unspaced = ["".join(rng.choice("ab19xyz0") for _ in range(400)), "".join(rng.choice("中文字。，かな") for _ in range(400)), "<|endoftext|>" * 20]
    for t in unspaced:
        cut = [b for _, b in chunked_encoding.blocks(t, 40)]
        assert (len(cut) > 5 or "|" in t) and "".join(cut) == t and [i for b in cut for i in library.encode(b, add_special_tokens=False).ids] == library.encode(t, add_special_tokens=False).ids


def shares(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """The targets by the contract's own words: what exceeds a cap is dealt again until none is above."""
    out, left, open_ = [0.0] * len(sizes), share * sum(sizes), set(range(len(sizes)))
    weigh = [weights[i % len(weights)] for i in range(len(sizes))]
    while open_:
        level = left / sum(weigh[i] for i in open_)
        over = {i for i in open_ if level * weigh[i] > cap * sizes[i]}
        for i in over or open_:
            out[i] = cap * sizes[i] if over else level * weigh[i]
        left -= sum(out[i] for i in over)
        open_ = open_ - over if over else set()
    return out


def test_targets(spark):
    rng = random.Random(61)
    for sizes in ([100, 10, 1000], [0, 0], [7], [0, 5, 0, 9], [rng.randrange(1000) for _ in range(50)], [1, 10**12, 3, 2]):
        rows = spark.createDataFrame([(f"s{i:03}", x, 1) for i, x in enumerate(sizes)], "key string, source_size long, n long")
        found = [r.target for r in mixing.targets(rows).orderBy("key").collect()]
        assert found == pytest.approx(shares(sizes), rel=1e-12), sizes


def test_mixing(spark):
    rows = corpus()
    out = mixing.systematic_copies(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    target = dict(zip(order, shares([sizes[s] for s in order]), strict=True))
    taken, largest = Counter(), Counter()
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source]) and r.taken == r.copies * r.size <= 2 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - target[s]) <= 2 * largest[s] for s in sizes)
    assert sorted(map(str, out)) == sorted(map(str, mixing.systematic_copies(frame(spark, rows).repartition(5)).collect()))
    assert mixing.systematic_copies(frame(spark, [])).count() == 0


def test_quality_rules(spark):
    rows = corpus() + [(700, "a b c d e f g h " * 5, "en", "a"), (701, "one two three four five six seven eight nine one two three four five six seven eight " + prose(random.Random(1), 40), "en", "a")]
    rows += [(702, "#$% " * 80, "en", "a"), (703, "LOUD!! " + "TEXT!! OF!! CAPS!! " * 1 + " ".join(f"ABC{i}!!" for i in range(80)), "en", "a")]
    out = got(quality_rules.judge(frame(spark, rows)))
    for i, text, *_ in rows:
        text = text or ""
        w = WORD.findall(text)
        windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        cover = {k + j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(8)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want = {"doc_id": i, "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(cover), "base_failed": len(w) < 20 or 100 * len(cover) > 30 * len(w)}
        assert any(all(r[k] == v for k, v in want.items()) for r in out[i]), (i, out[i], want)
        assert all(not r["kept"] for r in out[i] if r["base_failed"])
    assert not out[703][0]["kept"] and out[5][0]["kept"] == (not out[5][0]["base_failed"])
    p, q = [3.0, 1.0, 0.0], [1.0, 1.0, 2.0]
    got_d = spark.range(1).select(quality_rules.jensen_shannon(F.array(*map(F.lit, p)), F.array(*map(F.lit, q))).alias("d")).first().d
    a, b = [x / sum(p) for x in p], [x / sum(q) for x in q]
    m = [(x + y) / 2 for x, y in zip(a, b, strict=True)]
    kl = lambda x: sum(u * math.log2(u / v) for u, v in zip(x, m, strict=True) if u)
    assert got_d == pytest.approx(math.sqrt((kl(a) + kl(b)) / 2))
    assert quality_rules.judge(frame(spark, [])).count() == 0


def distance_by_hand(p, q):
    if not sum(p) or not sum(q):
        return 0.0
    a, b = [x / sum(p) for x in p], [x / sum(q) for x in q]
    m = [(x + y) / 2 for x, y in zip(a, b, strict=True)]
    kl = lambda x: sum(u * math.log2(u / v) for u, v in zip(x, m, strict=True) if u)
    return math.sqrt(max(0.0, (kl(a) + kl(b)) / 2))


def test_quality_rules_take_trusted_text_as_reference(spark):
    """Common words, references, distances and verdicts against plain loops; languages with and without trusted text, a
    null language, labels of null id, of absent documents, repeated and contradicting nothing, rows of one id."""
    rng = random.Random(9)
    rows = [(i, prose(rng, 60 + i % 90), ["en", "de", None, "fr"][i % 4], "a") for i in range(80)]
    rows += [(None, prose(rng, 120), "en", "a"), (3, "!?; " * 90 + prose(rng, 30), "fr", "a"), (90, None, "en", "a"), (91, "", None, "a")]
    rows += [(92, "x" * 5000 + " " + " ".join(f"Z{i}" for i in range(130)), "en", "b"), rows[0], (93, "only short", "es", "a")]
    good = [i for i in range(0, 80, 1) if i % 4 != 1 or i < 8] + [90, 91, 93, 500]
    labels = spark.createDataFrame([(i, 1, 0, "extra") for i in good] + [(0, 1, 0, ""), (None, 1, 0, ""), (92, 0, 0, ""), (61, 1, 1, ""), (65, None, 0, "")], "doc_id long, quality int, toxic int, lang string")
    docs, least, trusted = [], 10, set(good)
    for i, text, lang, _ in rows:
        text = text or ""
        w = WORD.findall(text)
        windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        cover = {k + j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(8)}
        kind = lambda c: 0 if c.islower() else 1 if c in " \t\n\v\f\r" else 2 if c.isupper() else 3 if c.isdigit() else 4 if c in ".,;:!?'\"()-" else 5
        n = Counter(map(kind, text))
        docs.append((i, lang, text, [x.lower() for x in w], len(w) < 20 or 100 * len(cover) > 30 * len(w), [n[j] for j in range(6)]))
    refs = {}
    for lang in {d[1] for d in docs}:
        mine = [d for d in docs if d[1] == lang]
        known = [d for d in mine if d[0] in trusted]
        having = Counter(x for d in known if len(d[3]) >= 20 for x in set(d[3]))
        bins = [x for x, _ in sorted(having.items(), key=lambda h: (-h[1], h[0].encode()))[:16]] if sum(len(d[3]) >= 20 for d in known) >= least else None
        known = [d for d in known if not d[4]]
        held = lambda d: [d[3].count(b) for b in bins] + [sum(x not in bins for x in d[3])]  # noqa: B023, E731
        enough = len(known) >= least
        of = known if enough else [d for d in mine if not d[4]]
        refs[lang] = [sum(x) for x in zip(*(d[5] for d in of), strict=True)] if of else [], bins, [sum(x) for x in zip(*map(held, known), strict=True)] if bins and enough else []
    assert [lang for lang in refs if refs[lang][1]] and refs["de"][1] is None and refs["es"][1] is None
    out = quality_rules.judge(frame(spark, rows), labels, least_trusted=least).collect()
    assert len(out) == len(rows)
    want = []
    for i, lang, text, w, failed, classes in docs:
        ref, bins, words = refs[lang]
        c = distance_by_hand(classes, ref) if len(text) >= 200 else 0.0
        v = distance_by_hand([w.count(b) for b in bins] + [sum(x not in bins for x in w)], words) if bins and len(w) >= 100 else 0.0
        want.append((i, failed, not failed and c <= 0.25 and v <= 0.28, round(c, 9), round(v, 9)))
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.base_failed, r.kept, round(r.char_distance, 9), round(r.word_distance, 9)) for r in out), key=key) == sorted(want, key=key)
    assert any(x[4] > 0.28 for x in want) and sum(x[2] for x in want) > 60


def by_hand(text, words=4):
    parts = [w for w in WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))]
    if not parts:
        return 0
    shingles = [" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
    hs = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(spark):
    rows = corpus()
    out = got(simhash.near_duplicates(frame(spark, rows)))
    prints = [(r[0], by_hand(r[1])) for r in rows]
    nodes = {p for _, p in prints}
    roots = union_find(nodes, [(a, b) for a in nodes for b in nodes if a < b and (a ^ b).bit_count() <= 4])
    least = {}
    for i, p in prints:
        if i is not None:
            least[roots[p]] = min(i, least.get(roots[p], i))
    for i, p in prints:
        assert {"doc_id": i, "fingerprint": f"{p:016x}", "component_id": least.get(roots[p])} in out[i]
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_rows_without_an_id_link_others(spark, monkeypatch):
    """1 and 2 are alike only by way of a row of no id; a component without any id has none."""
    prints = [(1, 0), (None, 0b1111), (2, 0b11111111), (None, 0xA5A5 << 48), (None, (0xA5A5 << 48) | 1), (5, 2**40 - 1), (5, 2**40 - 1), (9, 2**40 - 1)]
    rows = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in prints], "id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, *_: docs)
    out = sorted(((r.id, r.component_id) for r in simhash.near_duplicates(rows, id_col="id").collect()), key=str)
    assert out == sorted([(1, 1), (None, 1), (2, 1), (None, None), (None, None), (5, 5), (5, 5), (9, 5)], key=str)


def test_pigeonring_loses_no_link(spark):
    rng = random.Random(4)
    centres = [rng.getrandbits(64) for _ in range(40)]
    prints = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for c in centres for _ in range(25)}
    prints |= {centres[0] ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)}  # a very large group
    rows = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(sorted(prints))]
    edges = [(r.a, r.b) for r in simhash.links(spark.createDataFrame(rows, "id long, fp long")).collect()]
    fp = dict(enumerate(sorted(prints)))
    assert all((fp[a] ^ fp[b]).bit_count() <= 4 for a, b in edges) and len(edges) < 70 * len(rows)
    want = union_find(fp, [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 4])
    assert union_find(fp, edges) == want


def test_decontamination(spark):
    rng = random.Random(6)
    items = [(i, prose(rng, rng.randint(15, 40), 3000)) for i in range(20)] + [(50, "tiny item of six words here"), (51, None), (52, "")]
    docs, want = [], set()
    for i in range(40):
        docs.append((i, prose(rng, 200, 3000), "en", "a"))
    for k, (item, text) in enumerate(items[:21]):
        w = text.split()
        if k % 3 == 1 and k < 20:  # substitutions, one in ten
            for j in range(3, len(w), 10):
                w[j] = "changed"
        if k % 3 == 2 and k < 20:  # a part, in capitals
            w = [x.upper() for x in w[: max(13, len(w) // 2)]]
        docs.append((100 + k, f"{prose(rng, 50, 3000)} {' '.join(w)} {prose(rng, 50, 3000)}", "en", "a"))
        want.add((100 + k, item))
    docs += [(300, None, None, None), (301, "", None, None), docs[45]]
    bench = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, doc string")
    out = decontaminate.contaminated(frame(spark, docs), bench).collect()
    assert {(r.doc_id, r.item_id) for r in out} == want
    for r in out:
        tokens = decontaminate.normalized(dict((d[0], d[1]) for d in docs)[r.doc_id]).split()
        item = decontaminate.normalized(dict(items)[r.item_id]).split()
        part = tokens[r.doc_start : r.doc_start + r.n_tokens]
        assert any(sum(a == b for a, b in zip(part, item[k:], strict=False)) == r.n_matches for k in range(len(item))) and r.n_matches >= 0.8 * r.n_tokens
    assert decontaminate.contaminated(frame(spark, []), bench).count() == 0
    assert decontaminate.contaminated(frame(spark, docs), bench.limit(0)).count() == 0


def test_masks_find_every_passage():
    """All patterns of 5 to 25 tokens, begun and ended by equal tokens, with up to a fifth substituted."""
    marks = [int(m, 2) for m in decontaminate.MASKS]
    for n in range(5, 26):
        for gone in range(n // 5 + 1):
            for places in itertools.combinations(range(1, n - 1), gone):
                same = (1 << n) - 1 - sum(1 << p for p in places)
                assert any(same >> k & m == m for m in marks for k in range(n - m.bit_length() + 1)), (n, places)


def test_decontamination_substituted(spark):
    """Passages of 13 to 20 tokens with a fifth of them substituted anywhere."""
    rng = random.Random(31)
    items, docs = [(i, prose(rng, 40, 10**6)) for i in range(7)], []
    for i, text in items:
        n = 13 + i % 8
        for k, places in enumerate(rng.sample(list(itertools.combinations(range(1, n - 1), n // 5)), 40)):
            part = ["changed" if p in places else w for p, w in enumerate(text.split()[10 : 10 + n])]
            docs.append((100 * i + k, f"{prose(rng, 20, 10**6)} {' '.join(part)} {prose(rng, 20, 10**6)}", "en", "a"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame(spark, docs), bench).collect()}
    assert out == {(d[0], d[0] // 100) for d in docs}


def test_decontamination_short_items(spark):
    """Halves of items of 5 to 25 tokens, and short items with a substitution."""
    rng = random.Random(32)
    items, docs = [(n, prose(rng, n, 10**6)) for n in range(3, 26)], []
    for n, text in items:
        w, half = text.split(), max(5, (n + 1) // 2)
        docs.append((n, f"{prose(rng, 9, 10**6)} {' '.join(w[n // 3 : n // 3 + half] if n // 3 + half <= n else w[n - half :])} {prose(rng, 9, 10**6)}", "en", "a"))
        docs.append((100 + n, f"{prose(rng, 9, 10**6)} {' '.join([*w[:2], 'changed', *w[3:]])} {prose(rng, 9, 10**6)}", "en", "a"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame(spark, docs), bench).collect()}
    assert out == {(d[0], d[0] % 100) for d in docs if d[0] % 100 >= 5}


def test_decontamination_blocks(spark, monkeypatch):
    rows = corpus()
    bench = spark.createDataFrame([(i, r[1]) for i, r in enumerate(rows[:30])], "item_id long, text string")
    pairs = lambda: {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame(spark, rows), bench).collect()}
    whole = pairs()
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 2000)
    assert pairs() == whole and {(i, i) for i in range(30) if len((rows[i][1] or "").split()) >= 5} <= whole


def passages_by_hand(doc, item, tolerance=0.2, least=13):
    """(most matches of a passage, whether there is one): all diagonals, all stretches begun and ended by equal tokens."""
    need, top = min(least, max(5, (len(item) + 1) // 2)), None
    for shift in range(-len(item), len(doc)):
        same = [k for k in range(len(item)) if 0 <= k + shift < len(doc) and doc[k + shift] == item[k]]
        longest = max(((b - a + 1, -a) for i, a in enumerate(same) for j, b in enumerate(same[i:], i) if (b - a + 1) * (1 - tolerance) <= j - i + 1 + 1e-9), default=None)
        if longest and longest[0] >= need:
            matches = sum(-longest[1] <= k < -longest[1] + longest[0] for k in same)
            top = max(top or 0, matches)
    return top


def test_decontamination_several_passages_a_diagonal(spark):
    """Few words, so that passages meet, lie on one diagonal, and repeat."""
    rng = random.Random(33)
    items = [(i, " ".join(f"i{i}w{rng.randrange(60)}" for _ in range(rng.randint(10, 60)))) for i in range(12)]
    items += [(20, "one " * 40), (21, "a b " * 30), (22, "p q r s " * 12 + "t u v w x y z")]
    docs = []
    for k in range(150):
        words = items[k % len(items)][1].split()
        doc = [w if rng.random() < rng.choice([0.5, 0.85, 0.95]) else f"x{rng.randrange(10**6)}" for w in words]
        if k % 3 == 0:  # parts of it far from each other in likeness, at their places
            for a in range(0, len(doc), 15):
                if rng.random() < 0.4:
                    doc[a : a + 9] = [f"y{rng.randrange(10**6)}" for _ in doc[a : a + 9]]
        if k % 4 == 0:
            doc = doc[rng.randrange(10) :] + doc[: rng.randrange(10)]
        docs.append((k, " ".join(["before"] * rng.randrange(3) + doc + ["after"]), "en", "a"))
    out = {(r.doc_id, r.item_id): r.n_matches for r in decontaminate.contaminated(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(d[0], i): passages_by_hand(d[1].split(), t.split()) for d in docs for i, t in items}
    assert set(out) == {k for k, n in want.items() if n} and len(out) > 60
    assert all(want[k] >= n >= 0.8 * want[k] for k, n in out.items())


def test_passage_beside_a_longer_stretch(spark):
    """A passage is found though a longer stretch of its diagonal, of the same likeness, ends on unequal tokens."""
    item = [f"t{i}" for i in range(60)]
    passage = [w if i not in (3, 8) else "sub" for i, w in enumerate(item[20:33])]
    far = [f"n{i}" for i in range(7)]
    docs = [(1, " ".join(item[:12] + far + ["x"] + passage), "en", "a"), (2, " ".join(passage), "en", "a")]
    out = decontaminate.contaminated(frame(spark, docs), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert {r.doc_id for r in out} == {1, 2}


def test_repeated_tokens_cost_their_length(spark):
    import time

    docs = [(1, "again " * 20_000, "en", "a"), (2, "to and fro " * 7_000, "en", "a")]
    bench = spark.createDataFrame([(1, "again " * 10_000), (2, "to and fro " * 3_000)], "item_id long, text string")
    found, start = decontaminate.contaminated(frame(spark, docs), bench), time.time()
    assert {(r.doc_id, r.item_id, r.n_tokens) for r in found.collect()} == {(1, 1, 10_000), (2, 2, 9_000)} and time.time() - start < 30


def lines_by_hand(rows):
    norm = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x.lower()).strip(" ")
    places = [(r[0], k, norm(x)) for r in rows for k, x in enumerate((r[1] or "").split("\n")) if norm(x)]
    texts = sorted({p[2] for p in places})
    sets = {t: {t[k : k + 9] for k in range(max(1, len(t) - 8))} for t in texts}
    edges = [(a, b) for a in texts for b in texts if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    return places, union_find(texts, edges)


def test_line_dedup(spark):
    rng = random.Random(7)
    lines = [prose(rng, rng.randint(1, 30), 900) for _ in range(30)]
    rows = []
    for i in range(60):
        picked = []
        for _ in range(rng.randint(0, 6)):
            words = rng.choice(lines).split()
            if rng.random() < 0.5 and len(words) > 12:
                words[rng.randrange(len(words))] = f"y{i}"
            picked.append(rng.choice(["  ", ""]) + " ".join(words))
        rows.append((i, "\n".join(picked), "en", "a"))
    rows += [(100, None, None, None), (101, "", None, None), (102, "\n \n", None, None)]
    places, roots = lines_by_hand(rows)
    first = {}
    for i, k, t in sorted(places):
        first.setdefault(roots[t], (i, k))
    want = {(i, k): first[roots[t]] != (i, k) for i, k, t in places}
    assert any(want.values())
    docs = got(line_dedup.dedup_lines(frame(spark, rows)))
    assert set(docs) == {r[0] for r in rows}
    for i in docs:
        assert docs[i][0]["removed"] == sorted(k for (d, k), gone in want.items() if d == i and gone)
    cut = line_dedup.without_lines(frame(spark, rows), line_dedup.dedup_lines(frame(spark, rows)))
    for r in cut.collect():
        text = dict((x[0], x[1]) for x in rows)[r.doc_id]
        assert r.text == (text if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if not want.get((r.doc_id, k))))
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0
    awkward = line_dedup.dedup_lines(frame(spark, corpus()))
    assert awkward.count() == len(corpus())


def test_line_dedup_without_spaces(spark):
    """Characters beyond the ninth of a word count, and near copies that differ in the first nine are found."""
    rng = random.Random(23)
    cjk = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(200))
    astral = "".join(chr(0x20000 + rng.randrange(3000)) for _ in range(30))
    path = "".join(rng.choice("abcdefgh/") for _ in range(200))
    lines = ["https://a.org/x", "https://a.org/y", "andththwhes.", "andththwhwh.", cjk, "中" + cjk, path, path[:3] + "#" + path[4:], cjk[:9] + cjk[50:90], astral, astral + "ab"]
    lines += ["https://example.com/" + "a" * 40 + "/q?x=1", "https://example.com/" + "z" * 40 + "/q?x=1", "internationalization", "internationale"]
    lines += ["unconditional", "unconditionally-and-forever-and-ever", cjk[:9] + cjk[100:140], cjk[:9] + cjk[150:190]]
    rows = [(i, t, "en", "a") for i, t in enumerate(lines)]
    assert {r.doc_id for r in line_dedup.dedup_lines(frame(spark, rows)).collect() if r.removed} == {5, 7, 10}
    texts = spark.createDataFrame([(t,) for t in lines], "t string").select("t", F.size(F.array_distinct(line_dedup.shingles(F.col("t")))).alias("n")).collect()
    assert all(r.n == len({r.t[k : k + 9] for k in range(len(r.t) - 8)}) for r in texts)


def test_line_dedup_recall(spark):
    """Pairs at a similarity of 0.8 to 0.9 of the exact Jaccard, in lines short and long: nine in ten are found and more."""
    rng, rows = random.Random(24), []
    for i in range(300):
        base = "".join(rng.choice("abcdefghijklmnop ") for _ in range(rng.randint(60, 600))).strip()
        edited = list(base)
        for at in rng.sample(range(20, len(base) - 20), max(1, len(base) // 100)):
            edited[at] = "#"
        rows += [(2 * i, base, "en", "a"), (2 * i + 1, "".join(edited), "en", "a")]
    places, roots = lines_by_hand(rows)
    want = {d for d, _, t in places if d % 2 and roots[t] == roots[places[d - 1][2]]}
    out = {r.doc_id for r in line_dedup.dedup_lines(frame(spark, rows)).collect() if r.removed}
    assert out <= want and len(want) > 150 and len(out) >= 0.97 * len(want)


def test_line_dedup_large_buckets(spark):
    """Near copies of lines that share most of their shingles with hundreds of others: as many pairs are found as by
    comparing all that share a bucket."""
    rng = random.Random(21)
    word = lambda: f"{rng.getrandbits(36):09x}"
    shared = [word() for _ in range(16)]
    family = [[word() for _ in range(4)] for _ in range(300)]
    rows = [(2 * i + k, " ".join([*shared, *(w[:2] + [word(), word()] if k else w)]), "en", "a") for i, w in enumerate(family) for k in range(2)]
    out = {(r.doc_id, k): k in r.removed for r in line_dedup.dedup_lines(frame(spark, rows)).collect() for k in range(r.n_lines)}
    places, roots = lines_by_hand(rows)
    first = {}
    for i, k, t in sorted(places):
        first.setdefault(roots[t], (i, k))
    want = {(i, k): first[roots[t]] != (i, k) for i, k, t in places}
    assert sum(want.values()) == 300
    assert sum(out[p] for p in want if want[p]) >= 290 and not any(out[p] for p in want if not want[p])


def kneser_ney(texts):
    """A model of word pairs by plain dictionaries: the log probability of a text's words."""
    pairs = Counter()
    vocab = set()
    for t in texts:
        w = WORD.findall(t)
        vocab |= set(w)
        pairs.update(zip([None, *w], w, strict=False))
    d = quality_lm.discounts([sum(c == k for c in pairs.values()) for k in (1, 2, 3, 4)])
    follows = Counter(b for _, b in pairs)
    e = quality_lm.discounts([sum(c == k for c in follows.values()) for k in (1, 2, 3, 4)])
    whole = sum(follows.values())
    total, left = Counter(), Counter()
    for (a, _), c in pairs.items():
        total[a] += c
        left[a] += d[min(c, 3)]
    spare = sum(e[min(c, 3)] for c in follows.values()) / whole / (len(vocab) + 1)

    def lower(b):
        return (follows[b] - e[min(follows[b], 3)]) / whole + spare if b in follows else spare

    def p(a, b):
        if a not in total:
            return lower(b)
        c = pairs[a, b]
        return (max(c - d[min(c, 3)], 0) + left[a] * lower(b)) / total[a]

    return lambda t: sum(math.log(p(a, b)) for a, b in zip([None, *WORD.findall(t)], WORD.findall(t), strict=False))


def test_counts_summed_in_task(monkeypatch):
    """Whatever a task can hold, the rows that it emits add up to the counts of all blocks, each key in its shard."""
    import numpy as np

    rng = random.Random(3)
    blocks = [Counter(rng.randrange(300) for _ in range(rng.randrange(80))) for _ in range(200)]
    arrays = [(np.array(sorted(b), np.uint64), np.array([b[k] for k in sorted(b)], np.int64)) for b in blocks]
    for held in (50, 1 << 20):
        monkeypatch.setattr(quality_lm, "HELD_KEYS", held)
        got, batches = Counter(), list(quality_lm.counted_in_task(iter(arrays), lambda keys: (keys % np.uint64(4)).astype(np.int64), 4))
        for batch in batches:
            for shard, keys, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for k, n in zip(quality_lm.unpack(keys, "u8").tolist(), quality_lm.unpack(counts, "u4").tolist(), strict=True):
                    assert k % 4 == shard
                    got[k] += n
        assert got == sum(blocks, Counter()) and (len(batches) == 1) == (held > 50)
    assert not list(quality_lm.counted_in_task(iter([]), None, 4))


def test_quality_model(spark):
    rows = corpus()
    train = [(i, prose(random.Random(i), 80)) for i in range(1000, 1040)]
    model = quality_lm.Model(spark.createDataFrame(train, "id long, text string"), bits=1 << 16)
    log_p = kneser_ney([t for _, t in train])
    out = got(quality_lm.scores(frame(spark, rows), model, "doc_id", "text", "lang"), "id")
    for i, text, lang, _ in rows:
        n = len(WORD.findall(text or ""))
        assert any(r["lang"] == lang and r["n_words"] == n and r["log_p"] == pytest.approx(log_p(text or ""), rel=1e-9, abs=1e-9) for r in out[i]), i
    assert sum(map(len, out.values())) == len(rows)


def test_quality_classifier(spark):
    rng = random.Random(11)
    clean = [(i, prose(rng, rng.randint(30, 100)), rng.choice(["en", "de"]), "a") for i in range(400)]
    junk = [(1000 + i, " ".join(f"Z{rng.getrandbits(40):x}!!" for _ in range(50)), "en", "a") for i in range(40)]
    rows = clean + junk + [(2000, None, None, None), (2001, "", None, None), (None, clean[0][1], None, None), (2002, "short one", "en", "a")]
    labels = spark.createDataFrame([(i, 1, 0, "x") for i in range(300)] + [(1000, 0, 0, "x"), (None, 1, 0, "x")], "doc_id long, quality int, toxic int, text string")
    out = got(quality_lm.classify(frame(spark, rows), labels))
    assert not any(out[r[0]][0]["kept"] for r in junk)
    held = [out[i][0]["kept"] for i in range(300, 400)]
    assert sum(held) >= 97 and all(out[i][0]["kept"] for i in (2000, 2001, 2002, None))
    none = quality_lm.classify(frame(spark, rows[:20]), labels.limit(0))
    assert all(r.kept for r in none.collect()) and none.count() == 20
    assert quality_lm.classify(frame(spark, []), labels).count() == 0


def toxic_by_hand(rows, toxic, trusted):
    """Evidence of each text by plain sets."""
    words = lambda t: set(WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t if c not in string.punctuation)))
    n, m = (Counter(w for t in texts for w in words(t)) for texts in (toxic, trusted))
    ratio = {w: math.log((n[w] - 0.5) / len(toxic) * len(trusted) / (m[w] + 0.5)) for w in n if n[w] >= quality_lm.TOXIC_DOCS}
    return [sum(v for w, v in ratio.items() if w in words(t or "") and v >= math.log(quality_lm.TOXIC_RATIO)) for _, t, *_ in rows]


def test_toxic_documents(spark):
    """A few toxic words in otherwise clean text; evidence against plain sets; repeated rows, null ids and short texts."""
    rng = random.Random(14)
    bad = [f"vile{k}" for k in range(8)]
    clean = [(i, prose(rng, rng.randint(30, 100)), "en", "a") for i in range(400)]

    def spoiled():
        w = prose(rng, 120).split()
        for at, b in zip(rng.sample(range(len(w)), 3), rng.sample(bad, 3), strict=True):
            w[at] = b.title() + "!"
        return " ".join(w)

    toxic = [(1000 + i, spoiled(), "en", "a") for i in range(80)]
    rows = [*clean, *toxic, (None, toxic[0][1], "en", "a"), (None, clean[0][1], "en", "a"), (1000, toxic[0][1], "en", "a"), (3000, "vile0 vile1 vile2", "en", "a"), (3001, None, "en", None)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(300)] + [(1000 + i, 1, 1) for i in range(40)], "doc_id long, quality int, toxic int")
    out = quality_lm.classify(frame(spark, rows), labels).collect()
    trained = {r.doc_id for r in labels.where("toxic = 0").where(~quality_lm.held_out("doc_id")).collect()}
    want = toxic_by_hand(rows, [r[1] for r in rows if r[0] is not None and 1000 <= r[0] < 1040], [r[1] for r in clean if r[0] in trained])
    assert sorted((r.doc_id is None, r.doc_id or 0, round(r.toxic_evidence, 6)) for r in out) == sorted((i is None, i or 0, round(w, 6)) for (i, *_), w in zip(rows, want, strict=True))
    assert sum(r.kept for r in out if r.doc_id is not None and 1040 <= r.doc_id < 1080) == 0  # not labelled
    assert sum(r.kept for r in out if r.doc_id is not None and r.doc_id < 400) >= 390
    assert sorted(r.kept for r in out if r.doc_id is None) == [False, True] and [r.kept for r in out if r.doc_id == 3000] == [False]
    assert [r.kept for r in out if r.doc_id == 3001] == [True]


def test_near_documents(spark):
    """The stage's near duplicates against the exact Jaccard of five-word shingles; scattered edits included."""
    rng, rows = random.Random(41), corpus()
    for i in range(40):
        base = prose(rng, 300, 10**6).split()
        for k, edits in enumerate((0, 2, 4, 6, 9)):
            w = list(base)
            for p in rng.sample(range(len(w)), edits):
                w[p] = f"y{k}"
            rows.append((1000 + 10 * i + k, " ".join(w), "en", "a"))
    shared = prose(rng, 60, 10**6)
    for i in range(60):  # more than a bucket's lines that share most, in pairs
        own = prose(rng, 20, 10**6)
        rows += [(2000 + 2 * i, f"{shared} {own}", "en", "a"), (2001 + 2 * i, f"{shared} {own} end", "en", "a")]

    def shingled(text):
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [(r[0], shingled(r[1])) for r in rows if r[0] is not None]
    nodes = list({s for _, s in sets})
    number = {s: i for i, s in enumerate(nodes)}
    like = lambda x, y: len(x & y) >= 0.8 * len(x | y)
    roots = union_find(range(len(nodes)), [(i, k) for i in range(len(nodes)) for k in range(i + 1, len(nodes)) if nodes[i] and nodes[k] and like(nodes[i], nodes[k])])
    least = {}
    for d, s in sets:
        least[roots[number[s]]] = min(d, least.get(roots[number[s]], d))
    want = {(d, least[roots[number[s]]]) for d, s in sets}
    out = {(r.doc_id, r.component_id) for r in near_docs.near_duplicates(frame(spark, rows)).collect() if r.doc_id is not None}
    assert out == want and sum(d != c for d, c in want if d >= 1000) > 150
    assert near_docs.near_duplicates(frame(spark, [])).count() == 0


def test_near_documents_of_large_buckets(spark, monkeypatch):
    """Documents that share most shingles with hundreds and are alike in pairs: all pairs are found, and what is made on
    the way grows with the documents' bands, neither with a bucket's square nor with the shingles."""
    rng, made, plain = random.Random(61), [], near_docs.stored
    shared = prose(rng, 60, 10**6)
    rows = []
    for i in range(150):
        own = prose(rng, 25, 10**6)
        rows += [(2 * i, f"{shared} {own}", "en", "a"), (2 * i + 1, f"{shared} {own} end", "en", "a")]

    def counted(df, name):
        out = plain(df, name)
        made.append((name, out.count()))
        return out

    monkeypatch.setattr(near_docs, "stored", counted)
    monkeypatch.setattr(near_docs, "PIECE", 20, raising=False)
    out = {r.doc_id: r.component_id for r in near_docs.near_duplicates(frame(spark, rows)).collect()}
    assert out == {i: i - i % 2 for i in range(300)}
    assert max(n for _, n in made) <= near_docs.BANDS * len(rows)


def test_sketches_rule_out_no_alike_pair(spark):
    rng, rows = np.random.default_rng(62), []
    for size in (1, 4, 5, 9, 40, 400, 3000):
        for k in range(40):
            x = rng.integers(0, 2**64, size, dtype=np.uint64)
            y = np.concatenate([x[rng.integers(0, size // 4 + 1) :], rng.integers(0, 2**64, rng.integers(0, size // 4 + 1), dtype=np.uint64)])
            n = len(np.intersect1d(x, y))
            rows.append((n >= 0.8 * (len(x) + len(y) - n), len(x), near_docs.sketch(x).tolist(), len(y), near_docs.sketch(y).tolist()))
    out = spark.createDataFrame(rows, "alike boolean, size_a long, sketch_a array<long>, size_b long, sketch_b array<long>").withColumn("may", near_docs.may_be_alike(0.8))
    assert out.where("alike AND NOT may").count() == 0 and out.where("alike").count() > 80 and out.where("NOT may").count() > 40


def test_pipeline(spark, tmp_path):
    rng = random.Random(12)
    rows = [(i, prose(rng, rng.randint(30, 100)), "en", rng.choice(["a", "b", "hot", None])) for i in range(300)]
    rows += [(400 + i, rows[i][1], "en", "a") for i in range(5)]  # copies
    rows += [(500 + i, " ".join(f"Z{rng.getrandbits(40):x}!!" for _ in range(50)), "en", "a") for i in range(10)]  # junk
    leak = prose(rng, 30)
    rows += [(600, f"{rows[7][1]} {leak}", "en", "a")]
    rows += [(601, None, None, None), (602, "", "en", "a"), (None, rows[8][1], "en", "a")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(250)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = common.table(spark, str(tmp_path), "documents"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, str(tmp_path)), "test")
        kept.append([r.doc_id for r in docs.collect()])
        assert docs.columns == columns or name == corpus_pipeline.STAGES[-1][0]
    quality, dedup, clean, mixed, shards = kept
    assert not set(quality) & set(range(500, 510)) and len(set(quality) & set(range(300))) >= 290
    assert not set(dedup) & set(range(400, 405)) and set(dedup) >= set(quality) & set(range(300))
    assert 600 in dedup and 600 not in clean and set(clean) >= set(dedup) - {600}
    assert set(mixed) <= set(clean) and max(Counter(mixed).values()) <= 2 and sorted(map(str, shards)) == sorted(map(str, mixed))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(shards)


def test_similar_pairs_are_compared_once(spark, monkeypatch):
    """Lines that share most shingles, in more than a small bucket and not alike: no pair is compared in two rounds."""
    rng, seen, plain = random.Random(26), [], line_dedup.similar
    word = lambda: f"{rng.getrandbits(36):09x}"
    common_part = [word() for _ in range(16)]
    rows = [(i, " ".join([*common_part, *(word() for _ in range(3))]), "en", "a") for i in range(80)]

    def watched(pairs, *more):
        seen.extend((r.a, r.b) for r in pairs.collect())
        return plain(pairs, *more)

    monkeypatch.setattr(line_dedup, "similar", watched)
    assert line_dedup.dedup_lines(frame(spark, rows)).count() == 80
    assert len(seen) > 80 and len(seen) == len(set(seen))
