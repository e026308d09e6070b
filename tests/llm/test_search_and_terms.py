"""The source audit, tree concatenation of BPE and ranked search against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from milpa.llm import divergence, ranked, tokenbin, treebpe
from milpa.llm.queries import tokenizer

DOCS = "doc_id long, text string, lang string, source string, key string, term string, n long"


def frame(spark, rows):
    """Rows with columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, "k", "t", 1) for r in rows], DOCS)


def invented(seed, n=160, very_long=False):
    rng = random.Random(seed)
    words = [a + b for a in ("ba", "co", "Du", "ñe", "l'a", "x-ba", "12") for b in ("", "na", "RO", "é,", ".", "7")]
    rows = []
    for i in range(n):
        lang, source = rng.choice(["en", "en", "en", "de", None]), rng.choice(["s0", "s0", "s1", "s2", None])
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(rng.choices(words[: rng.choice([4, 12, 42])], k=rng.randint(0, 60))), lang, source))
    rows += [rows[3], (None, "ba ba co", "en", "s1"), (n, None, "en", "s9"), (n + 1, "", "xx", "only"), (n + 2, "zz", "yy", "a"), (n + 3, "zz", "yy", "b")]
    return [*rows, (n + 4, "ba " * 700_000 + "\x00co", "en", "s1")] if very_long else rows


# ---- source audit -------------------------------------------------------------------------------------------------------------
def audited(rows, least, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held, counts = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        terms = [t.translate(lower) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        counts[lang or "", source or ""].update(terms)
        held[lang or ""].update(set(terms))
    out = set()
    for lang in held:
        kept = [t for t, n in held[lang].items() if n >= least]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}  # noqa: B023, E731
        groups = {s: c for (g, s), c in counts.items() if g == lang}
        q, ps = share(sum(groups.values(), Counter())), {s: share(c) for s, c in groups.items()}
        for s, p in ps.items():
            pairs = [(sum(abs(p[t] - ps[o][t]) for t in kept), o) for o in groups if o != s]
            terms = [(p[t] - q[t], t) for t in kept if groups[s][t] and p[t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                out |= {(lang, s, part, item, v, i) for i, (v, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most], 1)}
    return out


@pytest.mark.parametrize(("seed", "least", "top"), [(1, 30, 50), (2, 12, 5), (3, 1, 3)])
def test_audit_against_brute_force(spark, seed, least, top):
    rows = invented(seed)
    assert {tuple(r) for r in divergence.audit(frame(spark, rows).repartition(7), least, top).collect()} == audited(rows, least, top)


def test_audit_in_many_slices_and_blocks(spark, monkeypatch):
    rows = invented(4, very_long=True)
    monkeypatch.setattr(divergence, "TERMS", 3)
    assert {tuple(r) for r in divergence.audit(frame(spark, rows).coalesce(1), 20, 50).collect()} == audited(rows, 20, 50)


def test_audit_of_nothing(spark):
    assert divergence.audit(frame(spark, [])).count() == 0


@given(st.lists(st.integers(0, 2**62)))
def test_numbers_come_back(values):
    assert divergence.unpacked(divergence.packed(np.array(values, np.int64))[0]).tolist() == values


@settings(deadline=None, max_examples=60)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2), st.integers(0, 9), st.integers(1, 3)), max_size=60), st.integers(1, 6), st.integers(0, 60))
def test_documents_are_counted_to_the_bound(records, least, cut):
    """Merging in two steps decides as all records at once do, and keeps every occurrence."""
    place = lambda doc: doc % 3

    def step(rows):
        return zip(*(x.tolist() for x in divergence.merged(*(np.array(c, np.int64) for c in (zip(*rows, strict=True) if rows else ([], [], [], []))), least)), strict=True)

    rows = [(r, place(d), d, n) for r, _, d, n in records]
    got = list(step([*step(rows[:cut]), *step(rows[cut:])]))
    docs, total = defaultdict(set), Counter()
    for r, p, d, n in rows:
        docs[r].add(d)
        total[r, p] += n
    seen = Counter()
    for r, p, _, n in got:
        seen[r, p] += n
    assert seen == total
    assert {r for r, _, d, _ in got if d < 0} == {r for r, x in docs.items() if len(x) >= least}


# ---- tree concatenation -------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def bpe():
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    return path, Tokenizer.from_file(path)


def tree(text, path, most):
    return treebpe.concatenated([treebpe.encoded(x, path) for x in treebpe.leaves(text, path, most)], path).tolist()


ATOMS = st.sampled_from(["a", "the", "ab", " ", "  ", "\n", "'s", "'re", "'", "!", "...", "1", "234", "é", "日本", "🎉", "́", "\t", "<|endoftext|>", "ing", " ", "==", "zx"])


@settings(deadline=None, max_examples=400)
@given(st.lists(ATOMS, max_size=120), st.sampled_from([1, 2, 5, 17, 60]))
def test_tree_against_the_library(atoms, most):
    path, library = tokenizer("byte_bpe_50k.json"), treebpe.the_tokenizer(tokenizer("byte_bpe_50k.json"))
    text = "".join(atoms)
    assert tree(text, path, most) == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("letters", ["etaoin", "ab", " ", "\n ", "0123", "=-", "'s", "日本語", "é", "aA"])
def test_runs_that_the_pattern_does_not_split(bpe, letters):
    rng, (path, library) = random.Random(letters), bpe
    text = "".join(rng.choice(letters) for _ in range(5000))
    assert tree(text, path, 300) == library.encode(text, add_special_tokens=False).ids


def test_windows_stay_small(bpe, monkeypatch):
    """A join in a long unsplit run encodes windows, not the run."""
    path, rng, seen = bpe[0], random.Random(5), []
    text = "".join(rng.choice("etaoinshrdlu") for _ in range(200_000))
    parts = [treebpe.encoded(x, path) for x in treebpe.leaves(text, path, 10_000)]
    known = treebpe.encoded
    monkeypatch.setattr(treebpe, "encoded", lambda t, p: seen.append(len(t)) or known(t, p))
    assert treebpe.concatenated(parts, path).tolist() == bpe[1].encode(text, add_special_tokens=False).ids
    assert max(seen) < 2000


def test_coded_documents_against_the_library(spark, bpe):
    path, library = bpe
    rng = random.Random(6)
    texts = ["", None, "One, two.", "a<|endoftext|>b", "x" * 50_000, "word " * 20_000, "é" * 20_000 + "<|endoftext|>" + "\n" * 40_000, "".join(rng.choice("abc  \n") for _ in range(300_000)), " lead", "trail ", "a  b c"]
    rows = [(i, t, None, None) for i, t in enumerate([*texts, texts[4]])] + [(None, "no id", None, None)]
    coded = treebpe.encode(frame(spark, rows), path)
    got = Counter((r["doc_id"], bytes(r["ids"]), r["text"]) for r in treebpe.decode(coded, path).collect())
    ids = [library.encode(t or "", add_special_tokens=False).ids for _, t, _, _ in rows]
    assert got == Counter((r[0], np.array(x, "<u4").tobytes(), library.decode(x, skip_special_tokens=False)) for r, x in zip(rows, ids, strict=True))
    assert treebpe.encode(frame(spark, []), path).count() == 0


def test_ids_of_no_text_decode_as_the_library_does(spark, bpe):
    path, library = bpe
    rng = random.Random(7)
    many = [[rng.randrange(50257) for _ in range(40)] for _ in range(50)]
    df = spark.createDataFrame([(i, bytearray(np.array(x, "<u4").tobytes()), "old") for i, x in enumerate(many)] + [(99, None, "old")], "k long, ids binary, text string")
    got = {r["k"]: r["text"] for r in treebpe.decode(df, path).collect()}
    assert got == {i: library.decode(x, skip_special_tokens=False) for i, x in enumerate(many)} | {99: ""}


def test_special_texts_keep_their_id_in_token_files(bpe):
    import pyarrow as pa

    ids, cuts = tokenbin.encode_texts(pa.array(["a<|endoftext|> b", "c d", ""], pa.large_string()), bpe[0], 2)
    assert [ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:], strict=True)] == [bpe[1].encode(t, add_special_tokens=False).ids + [2] for t in ("a<|endoftext|> b", "c d", "")]


# ---- ranked search ------------------------------------------------------------------------------------------------------------
def searched(rows, items, k):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = lambda t: [x.translate(lower) for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    docs = [(r[0], Counter(terms(r[1]))) for r in rows]
    n, total, df = sum(1 for _, c in docs if c), sum(sum(c.values()) for _, c in docs), Counter(t for _, c in docs for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for doc, c in docs:
            m = 25 + 75 * sum(c.values()) * n // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            scores.append((-s, doc is None, doc))
        out += [(item, i, doc, -s) for i, (s, _, doc) in enumerate(sorted((x for x in scores if x[0] < 0), key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


ITEMS = [(1, "ba na co"), (1, "ba na co"), (1, "ba ba ñe 12"), (2, None), (3, ""), (4, "nowhere"), (None, "dure x ba"), (5, "ÑE Duna 127 l a bana co cona é")]


@pytest.mark.parametrize(("seed", "k"), [(1, 10), (2, 1), (3, 400)])
def test_search_against_brute_force(spark, seed, k, monkeypatch):
    rows = invented(seed)
    items = spark.createDataFrame([(*r, "x") for r in ITEMS], "item_id long, text string, doc_id string")
    got = ranked.search(frame(spark, rows).repartition(5), items, k).collect()
    assert sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got), key=str) == searched(rows, ITEMS, k)


def test_search_in_blocks_of_documents_and_items(spark, monkeypatch):
    rows = invented(8, very_long=True)
    monkeypatch.setattr(ranked, "SHARD", 200)
    monkeypatch.setattr(ranked, "ITEMS", 200)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = ranked.search(frame(spark, rows).coalesce(2), items, 10).collect()
    assert sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got), key=str) == searched(rows, ITEMS, 10)


def test_search_of_nothing(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranked.search(frame(spark, []), items).count() == 0
    assert ranked.search(frame(spark, invented(1)), items.limit(0)).count() == 0


@settings(deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 19), unique=True), st.integers(1, 9)), max_size=8), st.integers(1, 5), st.integers(0, 10**6))
def test_no_accumulator_is_missed(terms, k, seed):
    rng, full = np.random.default_rng(seed), np.zeros(20, np.int64)
    postings = [(np.array(sorted(at), np.int64), rng.integers(1, 50, len(at)), w) for at, w in terms]
    for at, part, w in postings:
        full[at] += part * w
    at, score = ranked.best(postings, 20, k)
    assert (full[at] == score).all()
    top = lambda pairs: sorted(((-s, i) for i, s in pairs if s > 0))[:k]
    assert top(zip(at.tolist(), score.tolist(), strict=True)) == top(enumerate(full.tolist()))


def test_sha_of_query_columns(spark, bpe):
    """The query's digests are those of the ids and the text."""
    from pyspark.sql import functions as F

    row = treebpe.decode(treebpe.encode(frame(spark, [(1, "Zwölf Boxkämpfer", None, None)]), bpe[0]), bpe[0]).select(F.sha2("ids", 256).alias("a"), F.sha2("text", 256).alias("b")).first()
    assert row["b"] == hashlib.sha256("Zwölf Boxkämpfer".encode()).hexdigest()
    assert row["a"] == hashlib.sha256(np.array(bpe[1].encode("Zwölf Boxkämpfer").ids, "<u4").tobytes()).hexdigest()
