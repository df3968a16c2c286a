"""The audit of sources, packing and vector codes against brute force, and on rows with every odd case."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.conftest import EDGES

TABLES = ["docs", "edges", "none"]


def audited(rows, least, top):
    """The audit by dictionaries. rows: lang, source, text."""
    held, counts, groups, out = defaultdict(Counter), defaultdict(Counter), defaultdict(set), []
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups[lang].add(source)
        held[lang].update(set(terms))
        counts[lang, source].update(terms)
    for lang, sources in groups.items():
        kept = [t for t, n in held[lang].items() if n >= least]
        v = len(kept)

        def shares(counter):
            n = sum(counter[t] for t in kept)
            return {t: 1 + 10**9 * (counter[t] + 5) // (n + 5 * v) for t in kept}

        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, f, i) for i, (item, f) in enumerate(items[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize(("table", "least", "top", "few"), [("docs", 30, 50, 64), ("docs", 2, 7, 1), ("edges", 1, 5, 1), ("edges", 30, 50, 64), ("none", 1, 5, 1)])
def test_divergence(request, table, least, top, few):
    from tessera.llm.divergence import divergence_audit

    df = request.getfixturevalue(table)
    out = divergence_audit(df, least=least, top=top, few=few)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"] and dict(out.dtypes)["rank"] == "int" and dict(out.dtypes)["value"] == "bigint"
    assert sorted(map(tuple, out.collect())) == audited([(r.lang, r.source, r.text) for r in df.collect()], least, top)


def test_divergence_in_small_blocks(docs, monkeypatch):
    """Tasks that hand on their counts early, and pairs in many slices."""
    from tessera.llm import divergence as d

    rows = [(r.lang, r.source, r.text) for r in docs.collect()]
    small = d.pair_sums
    monkeypatch.setattr(d, "GATHERED", 500)
    monkeypatch.setattr(d, "PAIRS", 40)
    monkeypatch.setattr(d, "pair_sums", lambda g, s, n: small(g, s, n, block=100))
    assert sorted(map(tuple, d.divergence_audit(docs, least=5).collect())) == audited(rows, 5, 50)


def test_divergence_broadcasts_no_terms(docs, monkeypatch):
    """What is known of the groups goes to the terms, never the terms to all tasks, however small their files are; many groups meet them by exchange."""
    from tessera.llm import divergence as d

    def joins(out):
        plan = out._jdf.queryExecution().executedPlan().toString()
        return set(re.findall(r"(\w+Join)(?:\(.*?\))? \[lang#\d+, source#\d+\], \[lang#\d+, source#\d+\], Inner(?:, (Build\w+))?", plan))

    few = d.divergence_audit(docs, least=5)
    assert joins(few) == {("BroadcastHashJoin", "BuildRight")}
    monkeypatch.setattr(d, "GROUPS", 0)
    many = d.divergence_audit(docs, least=5)
    assert joins(many) == {("SortMergeJoin", "")}
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) == audited([(r.lang, r.source, r.text) for r in docs.collect()], 5, 50)


def test_terms_with_equal_hashes():
    import pyarrow as pa

    from tessera.llm.divergence import LETTERS, term_ids
    from tessera.llm.words import Words

    w = Words(pa.array(["ab cd ab", None, "cd é ab"]), LETTERS)
    for hashes in (w.hashes(), np.zeros(len(w), np.uint64)):
        ids, first = term_ids(w, hashes)
        names = [w.word(i) for i in range(len(w))]
        assert [names[first[i]] for i in ids] == names and len(first) == 3


def test_radix_top(spark):
    from tessera.llm.divergence import radix_top

    rng = np.random.default_rng(4)
    rows = [(g, f"{'Ü' * int(rng.integers(0, 3))}same{i % 7}{i:04d}", int(v)) for g, n in (("a", 900), ("b", 3), ("c", 400)) for i, v in enumerate(rng.choice([0, 5, 1023, 1024, 1 << 20, (1 << 30) - 1], n))]
    rows += [("d", "t" * 40 + chr(97 + i), 9) for i in range(20)]
    df = spark.createDataFrame(rows, "g string, item string, value long")
    for k, few in ((1, 1), (10, 1), (150, 64), (500, 5)):
        want = []
        for g in "abcd":
            own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1].encode()))
            want += [(*r, i) for i, r in enumerate(own[:k], 1)]
        assert sorted(map(tuple, radix_top(df, ["g"], "value", "item", k, few=few).collect())) == sorted(want)


def tokens_of(text):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    if not hasattr(tokens_of, "own"):
        tokens_of.own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
        tokens_of.own.encode_special_tokens = True
    return [*tokens_of.own.encode(text or "", add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("table", TABLES)
def test_packing(request, table):
    import public_tokenizers as P

    from tessera.llm.packing import pack_documents, packed_sequences

    df = request.getfixturevalue(table)
    rows = [(r.doc_id, tokens_of(r.text)) for r in df.collect()]
    for limits in ({}, {"most": 3, "attention": 1 << 20, "rule": "dot"}, {"shard": 20, "weights": (1.0, 0.5, 0.5)}):
        most = limits.get("most", 1024)
        pieces = pack_documents(df, P.path("byte_bpe_50k.json"), P.PATTERN, with_ids=True, **limits)
        assert dict(pieces.drop("ids").dtypes) == {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"}
        out = pieces.collect()
        want, whole = Counter(), Counter()
        for doc, ids in rows:
            head = (len(ids) - 1) % 1024 + 1
            for i, (a, b) in enumerate(zip([0, *range(head, len(ids), 1024)], [*range(head, len(ids) + 1, 1024)], strict=True)):
                want[doc, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
                whole[tuple(ids[a:b])] += 1
        assert want == Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out)
        bins = defaultdict(list)
        for r in out:
            bins[r.sequence_id].append((r.offset, r.length))
        for parts in bins.values():
            parts.sort()
            assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
            assert sum(n for _, n in parts) <= 1024 and len(parts) <= most and sum(n * n for _, n in parts) <= 1 << 20
        if "most" not in limits and "shard" not in limits:
            assert len(bins) <= math.ceil(sum(len(ids) for _, ids in rows) / 1024) * 1.02 + 1
        sequences = packed_sequences(pieces).collect()
        assert len(sequences) == len(bins)
        parts = Counter()
        for s in sequences:
            at = 0
            for n in s.lengths:
                parts[tuple(s.ids[at : at + n])] += 1
                at += n
            assert at == len(s.ids)
        assert parts == whole


def test_encoder_is_the_library():
    import public_tokenizers as P

    from tessera.llm.packing import byte_bpe_encoder

    encode = byte_bpe_encoder(P.path("byte_bpe_50k.json"), P.PATTERN)
    for text in [t or "" for _, t, *_ in EDGES] + ["<|endoftext|> a", "   x\u0085\x1c y", "don't we'LL", "a" * 3000, "👩‍👩‍👧 ٣٤ ²½", "\t\t  \n\n \r\n x ", "\u0000﻿�"]:
        assert [*encode(text), 2] == tokens_of(text)


def test_best_fit():
    """Choices by hand, every capacity in its turn; few bins for many pieces."""
    from tessera.llm.packing import Bins, best_fit

    for rule, at in (("norm", 1), ("dot", 0)):
        bins = Bins((10, 4, 100), rule, (1.0, 0.0, 0.0))
        assert [bins.put((n, 1, n * n)) for n in (6, 7)] == [0, 1] and bins.put((3, 1, 9)) == at
    bins = Bins((10, 2, 1000))
    assert [bins.put((1, 1, 1)) for _ in range(4)] == [0, 0, 1, 1]  # documents
    bins = Bins((10, 9, 30))
    assert [bins.put((n, 1, n * n)) for n in (5, 3, 2, 2)] == [0, 1, 0 if 25 + 4 <= 30 else 1, 1]  # attention
    lengths = np.random.default_rng(2).integers(1, 1024, 20_000)
    for rule in ("norm", "dot"):
        where, offset = best_fit(lengths, (1024, 1024, 1 << 20), rule)
        assert np.bincount(where, lengths).max() <= 1024 and where.max() + 1 <= 1.01 * lengths.sum() / 1024
        ends = sorted(zip(where, offset, offset + lengths, strict=True))
        assert all(b[1] == (a[2] if a[0] == b[0] else 0) for a, b in zip(ends, ends[1:], strict=False))
    with pytest.raises(ValueError):
        Bins((1, 1, 1), "other")


def codes_of(rows, parts=8, entries=16, rounds=6):
    """Lloyd's rounds with Python's whole numbers. rows: id, vector, label."""
    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = max(1, -(-max((len(r[1]) for r in rows), default=0) // parts))
    whole = lambda x: math.floor(min(max(x * 4096, -(1 << 27)), 1 << 27))
    cut = []
    for _, v, _ in rows:
        v = [*map(whole, v), *[0] * (width * parts - len(v))]
        cut.append([v[p * width : (p + 1) * width] for p in range(parts)])
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[:entries]
    books = [[cut[i][p] for i in order] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [[min((far(x, e), k) for k, e in enumerate(books[p])) for p, x in enumerate(v)] for v in cut]
    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [v[p] for v, f in zip(cut, found, strict=True) if f[p][1] == k]
                if own:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found, of = assign(), Counter()
    for r, f in zip(rows, found, strict=True):
        of[r[2]] += sum(d for d, _ in f)
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((r[0], "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), of[r[2]], sha) for r, f in zip(rows, found, strict=True))


VECTORS = {
    "spread": lambda rng: [(i, rng.normal(size=16).tolist(), int(i % 3) or None) for i in range(300)],
    "one vector": lambda rng: [(i, [0.5, -0.25] * 4, None) for i in range(100)],
    "ties": lambda rng: [(int(i % 40), (rng.integers(-2, 3, 8) / 4096).tolist(), 1) for i in range(250)],
    "few": lambda rng: [(i, rng.normal(size=8).tolist(), 1) for i in range(3)],
    "odd": lambda rng: [(1, None, 1), (2, [1.0, None, 2.0], 1), (3, [float("nan"), 1.0], 1), (4, [float("inf"), 1.0], 1), (None, [1.0, 2.0], None), (5, [], 2), (6, [3.5] * 19, 2), (7, [1e30, -1e30], 3), (7, [1e30, -1e30], 3), (8, [-0.0001] * 5, None)],
    "none": lambda rng: [],
}


@pytest.mark.parametrize("name", VECTORS)
def test_vector_codes(spark, name):
    from tessera.llm.vectorcodes import vector_codes

    rows = VECTORS[name](np.random.default_rng(7))
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, code string, error int").repartition(3)
    for block in (1 << 20, 128 * 20):
        out = vector_codes(df, block=block)
        assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
        assert Counter(map(tuple, out.collect())) == codes_of(rows)


def test_filtering(monkeypatch):
    """Trees give every point its nearest entry, ties to the lower index, and the sums; whole subtrees go at once."""
    from tessera.llm import vectorcodes as v

    looked, near = [], v._nearest
    monkeypatch.setattr(v, "_nearest", lambda points, *a: (looked.append(len(points)), near(points, *a))[1])
    rng = np.random.default_rng(5)
    for n, width, spread in ((1, 1, 5), (16, 2, 2), (17, 3, 3), (1000, 2, 4), (3000, 3, 1 << 26), (5000, 2, 3000)):
        points, book = rng.integers(-spread, spread + 1, (n, width)), rng.integers(-spread, spread + 1, (16, width))
        looked.clear()
        tree = v.Tree.unpacked(v.Tree.built(points).packed(), width)
        owner, sums, counts = tree.filtered(book)
        want = np.square(points[:, None] - book[None]).sum(2).argmin(1)
        back = np.empty(n, np.int64)
        back[tree.order] = owner
        assert np.array_equal(back, want) and np.array_equal(counts, np.bincount(want, minlength=16))
        assert np.array_equal(sums, [points[want == k].sum(0) for k in range(16)])
        if n == 5000:
            assert sum(looked) < n / 2
