"""BPE through a transducer, the filter audit and source divergences against brute force."""

from __future__ import annotations

import random
import uuid
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from conftest import SCHEMA, rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chronofact.llm import bpe, divergence, filter_audit
from chronofact.llm.queries import tokenizer
from chronofact.storage import shared_folder

LOW = -(2**63)
SPECIAL = ["<|endoftext|>a<|startoftext|> <|ENDOFTEXT|>", "don't WE'LL it's 'S", "İstanbul ΣΑΣ σας é ́x ﬁ", "a\tb\x0bc d　e\x1cf\r\ng", "日本語テキスト 😀👍🏽", "x" * 5000 + " " + "ab" * 900, "\x00\x01 �", "#$%&*| ___ 0123 4.5e-6"]


# --- 11: BPE.
def test_lexicon_is_a_minimal_transducer():
    rng = random.Random(5)
    for _ in range(150):
        words = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 40))}
        ids = {w: tuple(rng.randint(1, 3) for _ in range(rng.randint(1, 3))) for w in words}
        flat = bpe.Lexicon.compile(list(ids.items()))
        lexicon = bpe.Lexicon(flat)
        asked = [*words, *(bytes(rng.choice(b"abcd") for _ in range(rng.randint(0, 6))) for _ in range(50))]
        found, n, out = lexicon.look_up(asked)
        parts = np.split(out, np.cumsum(n)[:-1])
        assert [tuple(p) if f else None for p, f in zip(parts, found, strict=True)] == [ids.get(w) for w in asked]
        # As many states as there are different continuations, outputs written as early as they can be.
        tails = set()
        for prefix in {w[:i] for w in words for i in range(len(w) + 1)}:
            rest = {w[len(prefix) :]: o for w, o in ids.items() if w.startswith(prefix)}
            common = len(bpe.commonprefix(list(rest.values())))
            tails.add(frozenset((w, o[common if prefix else 0 :]) for w, o in rest.items()))
        assert flat[1] == max(1, len(tails))


def test_bpe_as_the_library(spark, docs, empty):
    library = Tokenizer.from_file(tokenizer())
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(SPECIAL)], "doc_id bigint, text string")
    for frame, words in ((docs, 40), (docs, 0), (more, 1000)):
        got = bpe.decode(bpe.encode(frame, tokenizer(), words=words), tokenizer()).collect()
        want = Counter()
        for r in frame.collect():
            ids = library.encode(r["text"] or "", add_special_tokens=False).ids
            want[r["doc_id"], tuple(ids), library.decode(ids, skip_special_tokens=False)] += 1
        assert Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in got) == want
    assert bpe.encode(empty, tokenizer()).count() == 0
    assert len(bpe.frequent_words(docs, most=40)) <= 40


def test_frequent_words_are_those_counted_most(docs):
    counts = Counter(w for r in rows() for w in (r[1] or "").replace("\n", " ").split(" ") if 0 < len(w.encode()) <= bpe.LONGEST)
    got = bpe.frequent_words(docs, most=60)
    assert got and min(counts[w] for w in got) >= max(n for w, n in counts.items() if w not in got)


# --- 12: filter audit.
def masks(rows, labels):
    least, out = {}, []
    for r in rows:
        i, t = LOW if r[0] is None else r[0], r[1] or ""
        least[t] = min(least.get(t, i), i)
    for r in rows:
        i, t = LOW if r[0] is None else r[0], r[1] or ""
        w = [x for x in "".join(" " if c in " \t\n\x0b\f\r" else c for c in t).split(" ") if x]
        fails = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), any(c in "#$%&*|" for c in t), i > least[t]]
        says = [label for label in labels if r[0] is not None and label[0] == r[0]]
        out.append((r[3] or "", fails, any(x[1] == 1 for x in says), any(x[2] == 1 for x in says)))
    return out


def audited(rows, labels):
    docs, out = masks(rows, labels), {}
    orders = ["".join(p) for p in permutations("ABCDE")]
    at = {f: "ABCDE".index(f) for f in "ABCDE"}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        shapley = Counter()
        for order in orders:
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[1][at[f]]]
                failing = [d for d in own if d[1][at[f]]]
                left = [d for d in left if not d[1][at[f]]]
                shapley[f] += len(gone)
                out[part, order, step] = [len(left), len(gone), len(failing) - len(gone), sum(sum(d[1]) == 1 for d in failing), sum(d[2] for d in gone), sum(d[3] for d in gone)]
        for order in orders:
            for step, f in enumerate(order, 1):
                out[part, order, step].append(shapley[f])
    return out


LABELS = [(0, 1, 0), (5, 1, 1), (6, 0, 1), (7, None, 1), (8, 1, None), (8, 0, 0), (14, 1, 0), (15, 1, 0), (16, 0, 1), (None, 1, 1)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_filter_audit_retracts(spark, seed):
    """One file a batch, in an order that lets smaller ids come later."""
    extra = [(i % 7 + 20 * (i % 3), f"copy {i % 5} of a text #", None, ["a", "b", None][i % 3], 9, None, None, None, None) for i in range(60)]
    every = rows() + extra
    random.Random(seed).shuffle(every)
    folder = f"{shared_folder(spark)}/docs-{uuid.uuid4().hex}"
    for a in range(0, len(every), 20):
        spark.createDataFrame(every[a : a + 20], SCHEMA).coalesce(2).write.mode("append").parquet(folder)
    labels = spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int")
    got = filter_audit.audit(folder, labels, spark.read.parquet(folder), files=1)
    keys = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(r["part"], r["filter_order"], r["step"]): [r[k] for k in keys] for r in got.collect()} == audited(every, LABELS)


def test_filter_audit_of_nothing(spark, empty):
    folder = f"{shared_folder(spark)}/docs-{uuid.uuid4().hex}"
    empty.write.parquet(folder)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit.audit(folder, labels, empty).count() == 0


# --- 13: source divergence.
def diverging(rows, min_docs, top):
    def terms(t):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c if c.isascii() and c.isalpha() or ord(c) >= 128 else " " for c in t or "").split(" ")

    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for r in rows:
        lang, source = r[2] or "", r[3] or ""
        groups[lang].add(source)
        own = Counter(x for x in terms(r[1]) if x)
        docs[lang].update(own.keys())
        counts[lang, source].update(own)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]

        def p(names, t, lang=lang, kept=kept):
            c = sum(counts[lang, s][t] for s in names)
            return 1 + 10**9 * (c + 2) // (sum(counts[lang, s][x] for s in names for x in kept) + 2 * len(kept))

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        for s in sources:
            pairs = [(sum(f(p([s], t), p([o], t)) for t in kept), o) for o in sources if o != s]
            words = [(f(p([s], t), p(sources, t)), t) for t in kept if counts[lang, s][t] and p([s], t) > p(sources, t)]
            for part, found in (("pair", pairs), ("term", words)):
                for rank, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1):
                    if part == "pair" or rank <= top:
                        out.add((lang, s, part, item, v, rank))
    return out


@pytest.mark.parametrize(("min_docs", "top", "block"), [(2, 10, 20_000), (1, 3, 7), (10, 10, 5), (50, 2, 100)])
def test_divergences(spark, docs, empty, min_docs, top, block):
    some = [r if len(r[1] or "") < 10_000 else (*r[:1], r[1][:3000], *r[2:]) for r in rows()]
    frame = spark.createDataFrame(some, SCHEMA).repartition(3)
    got = divergence.divergences(frame, min_docs=min_docs, top=top, block_entries=block).select("lang", "source", "part", "item", "value", "rank").collect()
    assert len(got) == len(set(got)) and set(map(tuple, got)) == diverging(some, min_docs, top)
    assert divergence.divergences(empty).count() == 0


def test_stripes_spill(docs, monkeypatch):
    whole = {(r["lang"], r["term"]): (r["docs"], dict(zip(r["sources"], r["counts"], strict=True))) for r in divergence.stripes(docs, min_docs=1).collect()}
    batch = docs.select(F.coalesce("text", F.lit("")).cast("binary"), F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit(""))).toArrow().to_batches()
    monkeypatch.setattr(divergence, "HELD", 50)
    spilled = [r for b in divergence._fold(iter(batch)) for r in b.to_pylist()]
    assert len(spilled) > len(whole)
    total = defaultdict(lambda: [0, Counter()])
    for r in spilled:
        total[r["lang"], r["term"]][0] += r["docs"]
        total[r["lang"], r["term"]][1].update(dict(zip(r["sources"], r["counts"], strict=True)))
    assert {k: (n, dict(c)) for k, (n, c) in total.items()} == whole
