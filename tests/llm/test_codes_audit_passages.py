"""Vector codes, the filter audit and repeated passages against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from pairwright.llm import audit, codes, passages

# ---- vector codes

VECTORS = "vec_id long, embedding array<double>, label int"


def brute_codes(rows, rounds=2):
    kept = []
    for vec_id, vector, label in rows:
        if vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            kept.append((vec_id, [math.floor(256 * x) for x in vector], label, vector))
    dims = -(-max([len(v) for _, v, _, _ in kept], default=0) // 16) * 16
    width = dims // 16
    parts = [[(v + [0] * dims)[p * width : (p + 1) * width] for p in range(16)] for _, v, _, _ in kept]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][3]))[:64]
    books = [[parts[i][p] for i in order] for p in range(16)]

    def nearest(part, book):
        distances = [sum((a - b) ** 2 for a, b in zip(part, entry)) for entry in book]
        return distances.index(min(distances)), min(distances)

    for _ in range(rounds):
        for p in range(16):
            members = defaultdict(list)
            for row in parts:
                members[nearest(row[p], books[p])[0]].append(row[p])
            books[p] = [
                [sum(c) // len(members[e]) for c in zip(*members[e])] if members[e] else entry
                for e, entry in enumerate(books[p])
            ]
    out, by_label = [], Counter()
    for (vec_id, _, label, _), row in zip(kept, parts):
        found = [nearest(row[p], books[p]) for p in range(16)]
        out.append((vec_id, "".join(f"{e:02x}" for e, _ in found), sum(d for _, d in found), label))
        by_label[label] += out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, by_label[label], digest) for i, c, e, label in out), key=repr)


def some_vectors(n=150, dims=32):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(dims)], rng.choice([1, 2, None])) for i in range(n)]
    rows += [(i, [rng.choice([0.0, 0.5, -0.25]) for _ in range(dims)], 1) for i in range(n, n + 40)]  # ties
    rows += [(3, rows[3][1], 2), (None, rows[5][1], None), (7, rows[8][1], 1), (901, None, 1), (902, [None] * dims, 1)]
    rows += [(903, [float("nan")] * dims, 1), (904, [float("-inf")] + [0.0] * (dims - 1), 1), (905, [], 3), (906, [0.1, 0.2], 4)]
    rows += [(907, [3e6, -2e6] * (dims // 2), 5)]  # squares beyond 64-bit sums are exact too
    return rows


@pytest.mark.parametrize("dims", [32, 20])
def test_codes(table, dims):
    rows = some_vectors(dims=dims)
    random.Random(1).shuffle(rows)
    made = codes.compress(table(VECTORS, rows)).collect()
    assert sorted(map(tuple, made), key=repr) == brute_codes(rows)


def test_few_and_no_vectors(table):
    few = some_vectors(5, 16)[:5]
    made = codes.compress(table(VECTORS, few)).collect()
    assert sorted(map(tuple, made), key=repr) == brute_codes(few) and all(r.error == 0 for r in made)
    assert codes.compress(table(VECTORS, [])).count() == 0
    assert codes.compress(table(VECTORS, [(1, None, 1)])).count() == 0


def test_many_labels(table, monkeypatch):
    """Beyond the broadcast bound, labels that hold more than a thousandth of the rows go their own way."""
    rows = [(i, [float(i % 7), 1.0], i if i > 1500 else None) for i in range(3000)]
    whole = {r.vec_id: r.label_error for r in codes.compress(table(VECTORS, rows), rounds=1).collect()}
    monkeypatch.setattr(codes, "FEW_LABELS", 10)
    assert {r.vec_id: r.label_error for r in codes.compress(table(VECTORS, rows), rounds=1).collect()} == whole


def test_candidates_hold_all_nearest():
    rng = np.random.default_rng(3)
    book = codes.Codebook(rng.integers(-5, 5, (64, 3)))
    values = rng.integers(-7, 7, (500, 3))
    distances = ((values[:, None] - book.entries) ** 2).sum(2)
    masks = book.candidates(values)
    for e in range(64):
        nearest = distances[:, e] == distances.min(1)
        assert (masks[nearest] >> np.uint64(e) & np.uint64(1)).all()
    assert sum(bin(int(m)).count("1") for m in masks) < 0.3 * 64 * len(values)
    found, least = book.nearest(values)
    assert (found == distances.argmin(1)).all() and (least == distances.min(1)).all()


# ---- filter audit

DOCS, LABELS = "doc_id long, text string, source string", "doc_id long, quality int, toxic int"


def brute_audit(docs, labels):
    seen = defaultdict(set)
    for doc_id, text, _ in docs:
        if doc_id is not None:
            seen[text or ""].add(doc_id)
    judged = defaultdict(lambda: [False, False])
    for doc_id, quality, toxic in labels:
        if doc_id is not None:
            judged[doc_id][0] |= quality == 1
            judged[doc_id][1] |= toxic == 1
    rows = []
    for doc_id, text, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": doc_id is not None and any(i < doc_id for i in seen[text]),
        }
        rows.append((source or "", fails, *(judged[doc_id] if doc_id is not None else (False, False))))
    out = []
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        shapley, found = Counter(), []
        for order in map("".join, permutations("ABCDE")):
            left, gone = own, []
            for step, f in enumerate(order, 1):
                removed = [r for r in left if r[1][f]]
                redundant = sum(r[1][f] for r in gone)
                left, gone = [r for r in left if not r[1][f]], gone + removed
                unique = sum(r[1][f] and sum(r[1].values()) == 1 for r in own)
                lost = [sum(r[2] for r in removed), sum(r[3] for r in removed)]
                shapley[f] += len(removed)
                found.append((part, order, step, len(left), len(removed), redundant, unique, *lost))
        out += [(*row, shapley[row[1][row[2] - 1]]) for row in found]
    return sorted(out)


def test_audit(table):
    rng = random.Random(5)
    docs = []
    for i in range(300):
        vocabulary = [f"w{j}" for j in range(rng.choice([5, 400]))]
        text = rng.choice([" ", "\t", " \n\v"]).join(rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 60, 90])))
        text += rng.choice(["", "", " UPPER CASE WORDS", " #x", "   ẞÉ"])
        docs.append((i, text, rng.choice(["web", "web", "web", None, "", "books"])))
    docs += [(i, docs[i % 7][1], "web") for i in range(300, 420)]
    docs += [(None, docs[0][1], "web"), (None, None, None), (5, docs[5][1], "web"), (5, None, "n"), (999, "x " * 40_000, "long")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 420, 2)]
    labels += [(2, 1, 0), (2, 0, 1), (None, 1, 1), (12345, 1, 1)]
    made = audit.interactions(table(DOCS, docs), table(LABELS, labels)).collect()
    assert sorted(map(tuple, made)) == brute_audit(docs, labels)
    assert audit.interactions(table(DOCS, []), table(LABELS, labels)).count() == 0
    assert audit.interactions(table(DOCS, docs[:9]), table(LABELS, [])).groupBy().sum("good_lost").first()[0] == 0


def test_packed_counters_do_not_carry():
    """Fields hold counts far beyond 32 bits beside each other."""
    many = 2**62 - 1
    total = many * audit.packed(0b00001, True, False) + 5 * audit.packed(0b11111, False, True)
    counts = audit.unpack(total)
    one, other = np.array(audit.outcomes(0b00001, True, False)), np.array(audit.outcomes(0b11111, False, True))
    assert (counts == many * one.astype(object) + 5 * other).all()


# ---- repeated passages


def brute_passages(texts):
    texts = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(t) else 0
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), int(gone[: len(t)].sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def passage_texts():
    rng = random.Random(6)

    def prose(n):
        return "".join(rng.choice("abcdefghij é日 ") for _ in range(n))

    shared = [prose(rng.choice([150, 199, 200, 201, 230, 320, 700])) for _ in range(12)]
    texts = []
    for _ in range(120):
        text = prose(rng.randrange(600))
        for _ in range(rng.randrange(3)):
            text += rng.choice(shared) + prose(rng.randrange(80))
        texts.append(text)
    edited = prose(3000)
    texts += [edited, edited[:900] + "X" + edited[901:], edited[:1500] + "YY" + edited[1500:], edited[400:]]
    # 200 bytes exactly, one less, whole copies, runs of one byte, short periods, overlaps within a text.
    same = "".join(rng.choice("klmnopq") for _ in range(200))
    texts += [same, "Z" + same, same[:199], same[1:], same[:100] + same[:100] + same]
    texts += [texts[0] + prose(250)] * 3 + ["a" * 199, "a" * 200, "b" * 201, "c" * 5000, "ab" * 700, "abc" * 1200 + "!" + "abc" * 90]
    return texts + ["", None, None, "日" * 66, "日" * 67, "日" * 68]


@pytest.mark.parametrize("large", [5_000, 3])
def test_passages(table, large):
    texts = passage_texts()
    made = passages.remove_repeats(table("doc_id long, text string", list(enumerate(texts))), large).collect()
    assert [tuple(r)[1:] for r in sorted(made)] == brute_passages(texts)


def test_passages_in_blocks(table, monkeypatch):
    """Blocks of a text, on the driver's side of the operator: the spans are those of the whole text."""
    texts = [t.encode() for t in passage_texts() if t and len(t.encode()) >= 200]

    def windows(block):
        monkeypatch.setattr(passages, "BLOCK", block)
        found = set()
        for number, key, _, first, last in passages._parsed(texts):
            for n, k, a, b in zip(number.tolist(), key.tolist(), first.tolist(), last.tolist()):
                found |= {(n, k, i) for i in range(a, b + 1)}
        return found

    whole, cut = windows(1 << 18), windows(300)
    assert whole == cut and len(whole) == sum(len(t) - 199 for t in texts)
    assert len({(n, i) for n, _, i in whole}) == len(whole)


def test_passages_without_rows(table):
    assert passages.remove_repeats(table("doc_id long, text string", [])).count() == 0
    rows = passages.remove_repeats(table("doc_id long, text string", [(None, None), (1, "x")])).collect()
    assert sorted(r.n_bytes for r in rows) == [0, 1] and all(r.n_removed == r.n_spans == 0 for r in rows)
