"""Leaked passages against a full alignment of every item with every document."""

import base64
import quopri
import random

import pytest

from tramline.llm.contamination import Items, extensions, least_shared, leaked_items, leaks, runs_of, shingle_hashes
from tramline.llm.mail import leaves, message_words, words

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
VOCAB = [a + b for a in ("ka", "lo", "mi", "ru", "te", "so", "na", "vi") for b in ("ra", "den", "pol", "sta", "mur", "fin")]


def full(item, doc):
    """By definition: some stretch item[a:b] of at least half the words, within (b - a) / 10 edits of some piece of doc."""
    n = len(item)
    half = (n + 1) // 2
    for a in range(n - half + 1):
        row = [0] * (len(doc) + 1)
        for k, w in enumerate(item[a:], 1):
            new = [k]
            for j, v in enumerate(doc, 1):
                new.append(min(row[j - 1] + (w != v), row[j] + 1, new[j - 1] + 1))
            row = new
            if k >= half and 10 * min(row) <= k:
                return True
    return False


def edited(rng, ws, share):
    out = []
    for w in ws:
        x = rng.random()
        if x < share / 3:
            continue
        if x < 2 * share / 3:
            out += [w, rng.choice(VOCAB)]
        else:
            out.append(rng.choice(VOCAB) if x < share else w)
    return out


def cases(n=60):
    rng = random.Random(3)
    items = [(k, " ".join(rng.choice(VOCAB) for _ in range(rng.choice([12, 24, 41, 60])))) for k in range(12)]
    docs = []
    for d in range(n):
        ws = [rng.choice(VOCAB) for _ in range(rng.randrange(20))]
        for _ in range(rng.randrange(3)):
            it = rng.choice(items)[1].split()
            size = int(len(it) * rng.choice([0.3, 0.45, 0.5, 0.55, 0.8, 1.0]))
            a = rng.randrange(len(it) - size + 1)
            ws += edited(rng, it[a : a + size], rng.choice([0, 0.05, 0.1, 0.15, 0.25])) + [rng.choice(VOCAB) for _ in range(rng.randrange(9))]
        docs.append((d, " ".join(ws)))
    return items, docs


def found(spark, docs, items, **kw):
    return {(r.doc_id, r.item_id) for r in leaked_items(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), **kw).collect()}


def test_same_as_full_alignment(spark):
    items, docs = cases()
    want = {(d, i) for d, t in docs for i, s in items if full(s.split(), t.split())}
    assert 20 < len(want) < len(docs) * len(items)
    assert found(spark, docs, items) == want


def test_bunched_edits_at_one_in_ten(spark):
    """Edits a few words apart leave long gaps between runs: as many as allowed, and one more."""
    items, docs = [], []
    for n in (100, 120, 150, 200, 250):
        ws = [f"w{n}x{k}" for k in range(n)]
        items.append((n, " ".join(ws)))
        for step in (3, 4, 5):
            for more in (0, 1):
                piece = ws[: n // 2]
                edits = n // 20 + more
                for k in range(edits):
                    piece[(len(piece) - step * (edits - 1)) // 2 + step * k] = f"other{k}"
                docs.append((len(docs), " ".join(piece)))
    want = {(d, i) for d, t in docs for i, s in items if f"w{i}x" in t and full(s.split(), t.split())}
    assert {(d, i) for d, i in want if d % 2 == 0} == {(d, items[d // 6][0]) for d in range(0, len(docs), 2)}
    assert found(spark, docs, items) == want


def test_blocks_of_items_change_nothing(spark):
    items, docs = cases(20)
    assert found(spark, docs, items, block_words=40) == found(spark, docs, items)


def test_encodings_quotes_and_markup(spark):
    text = "Während die Uhrenfee neun gefaltete Segel jenseits der dritten Wiese in Leinen hüllte, wurde der Schnee grau und kam ein Bote."
    part = lambda kind, coding, body: f"--B\nContent-Type: {kind}\nContent-Transfer-Encoding: {coding}\n\n{body}\n"
    head = 'Subject: x\nContent-Type: multipart/mixed;\n boundary="B"\n\n'
    b64 = base64.encodebytes(text.encode()).decode()
    qp = quopri.encodestring(text.encode("latin-1")).decode()
    wrapped = "\n".join(text.split(","))
    docs = [
        (1, head + part("text/plain; charset=utf-8", "base64", b64)),  # the closing boundary is missing
        (2, head + part("text/plain; charset=iso-8859-1", "quoted-printable", qp) + "--B--\n"),
        (3, "Subject: y\n\n" + "".join(f"BR> | > {line}\n" for line in wrapped.split("\n"))),
        (4, head + part("text/html", "8bit", "<p>" + text.replace("neun", "n<b>eu</b>n").replace(" Segel", "&nbsp;<i>Segel</i>") + "</p>") + "--B--"),
        (5, "Subject: z\r\n\r\n" + text.upper().replace("SEGEL", "SE­GEL").replace(" ", "  ")),
        (6, head + part("application/octet-stream", "base64", base64.encodebytes(bytes(range(256))).decode())),
        (7, None),
        (8, ""),
        (9, "Subject: only a header"),
    ]
    assert found(spark, docs, [(7, text)]) == {(k, 7) for k in range(1, 6)}


def test_ideographs_count_one_by_one():
    assert words("贩盐的老人，Bus-15路 ABC") == ["贩", "盐", "的", "老", "人", "bus", "15", "路", "abc"]
    assert words("Ferry’s élan über ｘ") == ["ferrys", "elan", "uber", "x"]


def test_edges(spark):
    item = " ".join(VOCAB[:20])
    assert found(spark, [(1, item)], []) == set()
    assert found(spark, [], [(1, item)]) == set()
    assert found(spark, [(1, item), (1, item)], [(1, item), (1, " ".join(VOCAB[20:40])), (2, None), (3, ""), (4, "...")]) == {(1, 1)}
    assert found(spark, [(1, "so it goes on")], [(5, "it goes")]) == {(1, 5)}  # a short item: half of it in one piece
    long = " ".join(VOCAB * 3000) + " " + " ".join(VOCAB[:20])
    assert (1, 1) in found(spark, [(1, long)], [(1, item)])


def test_parts_of_nested_and_broken_messages():
    inner = 'Content-Type: multipart/alternative; boundary="C"\n\n--C\nContent-Type: text/plain\n\nin\n--C--'
    assert [t.strip() for _, t in leaves('A: b\nContent-Type: multipart/mixed; boundary="B"\n\n--B\n' + inner + "\n--B\n\nout\n--B--\n")] == ["in", "out"]
    assert message_words("A: b\nContent-Type: multipart/mixed; boundary=none\n\nplain words") == [["plain", "words"]]
    assert message_words("no headers here") == [["no", "headers", "here"]]


@pytest.mark.parametrize("depth", [3, 8, 9, 40, 3000])
def test_parts_at_any_depth(depth):
    coded = base64.b64encode("zwölf nasse Segel".encode()).decode()
    text = f"Content-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: base64\n\n{coded}\n"
    forwards = "Content-Type: message/rfc822\n\n" * depth + text
    assert leaves(forwards) == [("text/plain", "zwölf nasse Segel")]
    if depth < 100:
        for k in range(depth):
            text = f'Content-Type: multipart/mixed; boundary="B{k}_"\n\n--B{k}_\n{text}\n--B{k}_--\n'
        assert message_words("Subject: x\n" + text) == [["zwolf", "nasse", "segel"]]


@pytest.mark.parametrize("n", [10, 11, 19, 20, 50, 99, 137])
def test_least_shared_is_a_bound(n):
    """Evenly spread edits, the worst case, leave at least that many shingles."""
    item = list(range(1, n + 1))
    half = (n + 1) // 2
    for length in range(half, n + 1):
        e = length // 10
        hit = {(k + 1) * length // (e + 1) for k in range(e)}
        kept = [not any(p in hit for p in range(q, q + 5)) for q in range(length - 4)]
        assert sum(kept) >= least_shared(n) or least_shared(n) == 1
    assert item


def test_runs_and_extensions():
    assert runs_of([(0, 0), (1, 1), (5, 9)]) == [(0, 0, 6), (5, 9, 5)]
    import numpy as np

    a, b = np.array([1, 2, 3, 4, 5]), np.array([1, 9, 3, 4, 5])
    assert extensions(a, b, 1) == [(1, 0), (5, 1)]
    it = Items([(1, " ".join(VOCAB[:12]))])
    w = it.words[0]
    assert len(shingle_hashes(w)) == 8 and leaks(w, w, runs_of([(k, k) for k in range(8)]))
