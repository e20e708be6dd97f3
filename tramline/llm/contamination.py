"""Evaluation passages in training texts: prefix-filtered set join on word shingles, exactly verified.

An item of n words leaks into a document that holds a stretch of L >= n / 2 of its words in order of which
at most L / 10 are changed, dropped or added. An edit breaks at most K shingles of K words, so such a stretch
shares at least min over L of L - K + 1 - K * floor(L / 10) shingles with the document (`least_shared`). Of the m
shingles of the item, ordered by rarity in the corpus, the rarest m - least_shared + 1 therefore hold one of
the shared ones: its necessary prefix.

One pass over the corpus turns texts into item-vocabulary numbers and keeps, of documents with any item
shingle, the shingles' positions and the words around them (`hits`, written once). Rarity is counted over all
documents; then each document's prefix shingles name candidate items, the number of shared shingles within
an item-sized window bounds them, and runs of shared words are chained to the exact stretch.

Items are the stated query set: they are taken in blocks of at most `block_words` words, and each block meets
all rows, whose texts are decoded once. A block's tables are what is broadcast, so that its size is bounded by that parameter.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm.mail import message_words, words
from tramline.session import cut, keep

K = 5
BLOCK_WORDS = 1_000_000
_MUL = np.uint64(0x9E3779B97F4A7C15)


def least_shared(n: int) -> int:
    """Shingles that any leaking stretch of an item of n words shares at the least; at least 1."""
    half = (n + 1) // 2
    return max(1, min((x - K + 1 - K * (x // 10) for x in range(half, n + 1)), default=1))


def shingle_hashes(ids: np.ndarray) -> np.ndarray:
    """64-bit hash of every K successive word numbers."""
    m = len(ids) - K + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        x = (ids.astype(np.uint64) + np.uint64(1)) * _MUL
        x ^= x >> np.uint64(29)
        h = np.zeros(m, np.uint64)
        for k in range(K):
            h = (h ^ x[k : k + m]) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
    return h


class Items:
    """A block of items: vocabulary, words, shingles. Items of under 2 * K words are held whole in `short`,
    and matched by their own words, since their stretches may be shorter than a shingle."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.vocab: dict[str, int] = {}
        self.words: dict[int, np.ndarray] = {}
        self.short: dict[int, np.ndarray] = {}
        self.ids: list[int] = []
        for item, (item_id, text) in enumerate(sorted(rows)):
            self.ids.append(item_id)
            w = words(text or "")
            ids = np.array([self.vocab.setdefault(x, len(self.vocab) + 1) for x in w], np.int32)
            if len(ids) >= 2 * K:
                self.words[item] = ids
            elif len(ids):
                self.short[item] = ids
        spots: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for item, ids in self.words.items():
            for q, h in enumerate(shingle_hashes(ids).tolist()):
                spots[h].append((item, q))
        self.hashes = np.array(sorted(spots), np.uint64)
        self.spots = [spots[h] for h in self.hashes.tolist()]
        self.longest = max(map(len, self.words.values()), default=0)

    def prefixes(self, rarity: dict[int, int]) -> dict[int, list[int]]:
        """shingle number -> items of whose necessary prefix it is."""
        by_item: dict[int, set[int]] = defaultdict(set)
        for s, spots in enumerate(self.spots):
            for item, _ in spots:
                by_item[item].add(s)
        out: dict[int, list[int]] = defaultdict(list)
        for item, own in by_item.items():
            # An item's own repeats make several places share a shingle; the bound counts places.
            places = len(self.words[item]) - K + 1
            need = max(1, least_shared(len(self.words[item])) - (places - len(own)))
            for s in sorted(own, key=lambda s: (rarity.get(s, 0), s))[: len(own) - need + 1]:
                out[s].append(item)
        return dict(out)


HITS = "doc_id long, part int, first int, words array<int>, at array<int>, shingle array<int>"
_HITS = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("first", pa.int32()), ("words", pa.list_(pa.int32())), ("at", pa.list_(pa.int32())), ("shingle", pa.list_(pa.int32()))])


def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches (doc_id, text) to the words of every readable part."""
    for b in batches:
        told = [(doc, p, ws) for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True) for p, ws in enumerate(message_words(text.as_py()))]
        if told:
            doc, part, ws = zip(*told, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(part, pa.int32()), pa.array(ws, pa.list_(pa.string()))], names=["doc_id", "part", "words"])


def find_hits(items: Items):
    """Arrow batches (doc_id, text), or (doc_id, part, words) of decoded texts, to the parts that share a shingle with an item, or hold a short item's words."""
    vocab, hashes, margin = items.vocab, items.hashes, 2 * items.longest
    short = {int(w) for i in items.short.values() for w in i}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocab.get
        for b in batches:
            docs, parts, flat, edges = [], [], [], [0]
            if "words" in b.schema.names:
                told = zip(b.column("doc_id").to_pylist(), b.column("part").to_pylist(), (x.as_py() for x in b.column("words")), strict=True)
            else:
                told = ((doc, p, ws) for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True) for p, ws in enumerate(message_words(text.as_py())))
            for doc, p, ws in told:
                flat += [get(w, 0) for w in ws]
                docs.append(doc)
                parts.append(p)
                edges.append(len(flat))
            out: dict[str, list] = {f.name: [] for f in _HITS}
            ids, bounds = np.array(flat, np.int32), np.array(edges)
            known = ids != 0
            m = len(ids) - K + 1
            hit, at = np.empty(0, int), np.empty(0, int)
            if m > 0 and len(hashes):
                run_of = np.convolve(known, np.ones(K, int), "valid") == K
                cand = np.flatnonzero(run_of)
                h = shingle_hashes(ids)[cand]
                s = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                ok = hashes[s] == h
                at, hit = cand[ok], s[ok]
                of = np.searchsorted(bounds, at, "right") - 1
                inside = at + K <= bounds[of + 1]
                at, hit, of = at[inside], hit[inside], of[inside]
            else:
                of = at
            lo = np.searchsorted(of, np.arange(len(docs)))
            hi = np.searchsorted(of, np.arange(len(docs)), "right")
            some = hi > lo
            if short:
                for k in range(len(docs)):
                    some[k] |= bool(short.intersection(flat[edges[k] : edges[k + 1]]))
            for k in np.flatnonzero(some):
                a, z = edges[k], edges[k + 1]
                pos = at[lo[k] : hi[k]]
                first, last = (a, z) if short or not len(pos) else (max(a, int(pos[0]) - margin), min(z, int(pos[-1]) + K + margin))
                for name, v in zip(out, (docs[k], parts[k], first - a, ids[first:last], (pos - first).astype(np.int32), hit[lo[k] : hi[k]].astype(np.int32)), strict=True):
                    out[name].append(v)
            if out["doc_id"]:
                yield pa.RecordBatch.from_pydict(out, schema=_HITS)

    return run


def edits(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Fewest changes, drops and additions that turn a into b; most + 1 if that takes more than `most`."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if not len(a) or not len(b):
        return max(len(a), len(b))
    a, b = a.tolist(), b.tolist()
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        # places further than `most` off the diagonal take more edits than that
        lo, hi = max(1, i - most), min(len(b), i + most)
        new = [most + 1] * (len(b) + 1)
        new[0] = i
        for j in range(lo, hi + 1):
            new[j] = min(row[j - 1] + (x != b[j - 1]), row[j] + 1, new[j - 1] + 1)
        if min(new) > most:
            return most + 1
        row = new
    return min(row[-1], most + 1)


def extensions(a: np.ndarray, b: np.ndarray, most: int) -> list[tuple[int, int]]:
    """(words of the item, edits) by which a stretch can go on: for every number of edits up to `most`, the most words of item a that some beginning of b has so."""
    a, b = a.tolist(), b.tolist()
    reach = {0: 0}  # diagonal -> furthest position in a, with e edits
    out = []
    for e in range(most + 1):
        new: dict[int, int] = {}
        for d, i in reach.items():
            if e == 0:
                steps = ((d, i),)
            else:
                steps = ((d, i + 1), (d - 1, i + 1), (d + 1, i))
            for dd, ii in steps:
                if ii > len(a) or not 0 <= ii + dd <= len(b):
                    continue
                while ii < len(a) and ii + dd < len(b) and a[ii] == b[ii + dd]:
                    ii += 1
                new[dd] = max(new.get(dd, -1), ii)
        if not new:
            break
        reach = new
        out.append((max(new.values()), e))
    return out


def leaks(item: np.ndarray, doc: np.ndarray, runs: list[tuple[int, int, int]]) -> bool:
    """Whether doc holds a stretch as defined. runs: maximal exact (place in doc, place in item, words) of at least K words."""
    n = len(item)
    half, most = (n + 1) // 2, n // 10
    if any(r[2] >= half for r in runs):
        return True
    runs = sorted(runs)
    for s, (p0, q0, w0) in enumerate(runs):
        # least edits of a chain from run s that ends with run k
        cost = {s: 0}
        for k in range(s, len(runs)):
            if k not in cost:
                continue
            p, q, w = runs[k]
            length, e = q + w - q0, cost[k]
            if length >= half and 10 * e <= length:
                return True
            # At both ends the stretch may go on over edits into runs of under K words: x more edits win
            # at most K * x + 2 * (K - 1) words, and must not be more than a tenth of all.
            spare = (length + 2 * (K - 1) - 10 * e) // (10 - K)
            if spare >= 0 and length + K * spare + 2 * (K - 1) >= half:
                reach = K * (spare + 2)
                after = extensions(item[q + w : q + w + reach], doc[p + w : p + w + reach], spare)
                before = extensions(item[max(0, q0 - reach) : q0][::-1], doc[max(0, p0 - reach) : p0][::-1], spare)
                for x, ex in before:
                    for y, ey in after:
                        if length + x + y >= half and 10 * (e + ex + ey) <= length + x + y:
                            return True
            # Between two runs of a stretch x edits leave less than K words before, between and after them.
            wide = K * (most - e) + K - 1
            for j in range(k + 1, len(runs)):
                p2, q2, w2 = runs[j]
                if p2 - (p + w) > wide:
                    break
                trim = max(0, p + w - p2, q + w - q2)
                if w2 - trim < 1 or q2 + trim - (q + w) > wide:
                    continue
                c = e + edits(item[q + w : q2 + trim], doc[p + w : p2 + trim], most - e)
                if c <= most and c < cost.get(j, most + 1):
                    cost[j] = c
    return False


def runs_of(pairs: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Maximal exact runs from the places (in doc, in item) of shared shingles."""
    out: list[tuple[int, int, int]] = []
    open_: dict[int, tuple[int, int, int]] = {}
    for p, q in sorted(pairs):
        r = open_.get(p - q)
        if r and r[0] + r[2] - K + 1 == p:
            open_[p - q] = (r[0], r[1], r[2] + 1)
            continue
        if r:
            out.append(r)
        open_[p - q] = (p, q, K)
    return out + list(open_.values())


def verify(items: Items, prefixes: dict[int, list[int]]):
    """Arrow batches of hits to (doc_id, item_id)."""
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64())])
    need = {i: max(1, least_shared(len(w))) for i, w in items.words.items()}

    def candidates(at: np.ndarray, shingle: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        named = {i for s in np.unique(shingle).tolist() for i in prefixes.get(s, ())}
        if not named:
            return
        places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for p, s in zip(at.tolist(), shingle.tolist(), strict=True):
            for i, q in items.spots[s]:
                if i in named:
                    places[i].append((p, q))
        for i, pairs in places.items():
            # positional bound: enough shared shingles within one item-sized window of the text
            ps = sorted({p for p, _ in pairs})
            wide = len(items.words[i]) + len(items.words[i]) // 10
            if any(k + need[i] <= len(ps) and ps[k + need[i] - 1] - ps[k] <= wide for k in range(len(ps))):
                yield i, pairs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, found = [], []
            for k in range(b.num_rows):
                doc = b.column("doc_id")[k].as_py()
                ws = b.column("words")[k].values.to_numpy()
                at, sh = b.column("at")[k].values.to_numpy(), b.column("shingle")[k].values.to_numpy()
                for i, pairs in candidates(at, sh):
                    if leaks(items.words[i], ws, runs_of(pairs)):
                        docs.append(doc)
                        found.append(items.ids[i])
                for i, w in items.short.items():
                    # under 2 * K words no edit is allowed: half of the words in one piece
                    half = (len(w) + 1) // 2
                    text = ws.tolist()
                    pieces = {tuple(w[q : q + half].tolist()) for q in range(len(w) - half + 1)}
                    if any(tuple(text[p : p + half]) in pieces for p in range(len(text) - half + 1)):
                        docs.append(doc)
                        found.append(items.ids[i])
            if docs:
                yield pa.RecordBatch.from_pydict({"doc_id": docs, "item_id": found}, schema=schema)

    return run


def leaked_items(docs: DataFrame, items: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id), distinct: every document with the items it holds, in any readable part.

    Null or empty texts hold nothing; items without words are held by nothing; repeated rows and an item id
    with several texts give one pair. Texts of any length are read whole. No items or no documents: no rows.
    """
    spark = docs.sparkSession
    sized = items.filter("item_id is not null and text is not null").select("item_id", "text")
    total = sized.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // (4 * block_words)))  # four characters a word, or fewer words
    corpus = docs.filter("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if blocks > 1:
        corpus = keep(corpus.mapInArrow(decode, "doc_id long, part int, words array<string>"))  # texts are decoded once for all blocks
    out = None
    for n in range(blocks):
        own = sized.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == n) if blocks > 1 else sized
        block = Items([(r.item_id, r.text) for r in own.distinct().collect()])
        shared = spark.sparkContext.broadcast(pickle.dumps(block))
        hits = cut(corpus.mapInArrow(_bound(find_hits, shared), HITS))
        rarity = hits.select("doc_id", F.explode(F.array_distinct("shingle")).alias("s")).groupBy("s").agg(F.count("*").alias("n"))
        prefixes = block.prefixes({r.s: r.n for r in rarity.collect()})  # at most as many rows as the block has shingles
        ready = spark.sparkContext.broadcast(pickle.dumps(prefixes))
        found = hits.select("doc_id", "words", "at", "shingle").mapInArrow(_bound(verify, shared, ready), "doc_id long, item_id long").distinct()
        out = found if out is None else out.unionByName(found).distinct()
    return out


def _bound(f, *broadcasts):
    def run(batches):
        return f(*[pickle.loads(b.value) for b in broadcasts])(batches)

    return run
