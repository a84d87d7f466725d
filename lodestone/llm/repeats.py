"""Removal of repeated byte strings by common-prefix interval trees over sparse suffix arrays.

Anchors: in every window of WIDTH bytes the GRAM-byte string with the least hash is an anchor, so two equal windows hold
equal anchors at the same place. Only suffixes that start at anchors are ever compared, and only those whose GRAM bytes occur
elsewhere too. Per anchor there are

1. its context, all bytes of the windows that hold it. Of equal contexts all but the earliest are covered as a whole;
2. for the earliest ones of different contexts on the same GRAM bytes: an enhanced suffix array (suffixes sorted, with
   the lengths of common prefixes), scanned with a stack into its tree of common-prefix intervals. Each interval is a
   repeat with all its occurrences. Its members are told apart by their left extensions: they are sorted by the bytes to
   the left, and every maximal run that extends far enough to the left to make WIDTH bytes is a maximal repeat group.
   In it each member is covered as far as it agrees with some earlier member;
3. a GRAM string with more than MANY different contexts (a very frequent line) is not gathered: its contexts are dealt out in
   parts of about MANY. A part covers what it has seen before itself, and sends each of its distinct windows on by hash, to be
   matched between parts in a grouped aggregation that combines before the shuffle.

Anchors are combined by context inside each batch before they are shuffled, so a large group of copies sends a row a batch.
Hashes are 64 bits of GRAM bytes and, by another function, 64 of the context or, in parts of a frequent string, of the window; both
must agree.

Defined cases: null text counts as empty; texts shorter than WIDTH keep all bytes; a null doc_id comes before all others;
rows that repeat a doc_id, or have none, are one document to the rule "earlier": only an earlier start in the same document counts,
so identical rows get identical results; each of its texts has its own anchors and spans (by a 64-bit hash of the text); matches never cross texts; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .shared import small_batches, written

WIDTH, GRAM = 100, 32
REACH = WIDTH - GRAM
MANY, AT_ONCE = 4096, 1 << 20

_rng = np.random.default_rng(20)
_FIRST, _SECOND = _rng.integers(1, 1 << 63, (2, 256), dtype=np.uint64)
_STEPS = [(s, np.uint64(int(b) | 1)) for s, b in zip((1, 2, 4, 8, 16), _rng.integers(1 << 40, 1 << 63, 5))]
_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, AT_ONCE + 1)
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _powers[k] = np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(n - 1, np.uint64(b)))])
    return _powers[0], _powers[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _sliding(x: np.ndarray, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over every REACH + 1 = 69 entries."""
    for s in (1, 2, 4, 8, 16, 32, REACH + 1 - 64):
        x = pick(x[:-s], x[s:])
    return x


def anchors(raws: list[bytes]) -> tuple[np.ndarray, ...]:
    """text index, place, bytes of context to the left and right, gram hash, context hash of every anchor, by text and place."""
    sizes = np.array([len(r) for r in raws])
    stop = np.cumsum(sizes)
    begin = stop - sizes
    buf = np.frombuffer(b"".join(raws), np.uint8)
    n = len(buf)
    h = _FIRST[buf]
    for s, b in _STEPS:
        h = h[:-s] * b + h[s:]
    low = (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    least = _sliding(low, np.minimum)
    for e in stop[:-1].tolist():
        least[max(0, e - WIDTH + 1) : e] = 0  # no window crosses texts
    pad = np.zeros(REACH, np.uint32)
    at = np.flatnonzero(low == _sliding(np.concatenate([pad, least, pad]), np.maximum))
    own = np.searchsorted(stop, at, side="right")
    a, b = np.maximum(begin[own], at - REACH), np.minimum(stop[own], at + WIDTH)
    up, down = _power(n + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_SECOND[buf] * up[:n])])
    shape = ((at - a) << 8 | (b - at)).astype(np.uint64)
    full = _mixed(_mixed((sums[b] - sums[a]) * down[a]) + shape * np.uint64(_BASE))
    return own, at - begin[own], at - a, b - at, _mixed(h[at]), full


ANCHORS = "gram long, full long, doc long, spot long, row long, done boolean"


def _frame(gram, full, doc, spot, row, done) -> pd.DataFrame:
    as_long = lambda x: np.asarray(x).astype(np.uint64).view(np.int64) if np.asarray(x).dtype == np.uint64 else np.asarray(x, np.int64)
    return pd.DataFrame({"gram": as_long(gram), "full": as_long(full), "doc": as_long(doc), "spot": as_long(spot), "row": as_long(row), "done": np.asarray(done, bool)})


def _emit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Anchors of each batch of (doc, row, raw); of equal contexts the earliest stays an anchor, the others are done: covered.

    spot packs place << 16 | left << 8 | right. Anchors of different texts of one doc at the same place are equally early: all stay.
    """
    for part in parts:
        rows = sorted(((d, w, r) for d, w, r in zip(part["doc"].tolist(), part["row"].tolist(), part["raw"]) if len(r) >= WIDTH), key=lambda x: x[:2])
        k = 0
        while k < len(rows):
            total, j = 0, k
            while j < len(rows) and (j == k or total + len(rows[j][2]) <= AT_ONCE):
                total += len(rows[j][2])
                j += 1
            own, at, left, right, gram, full = anchors([r for _, _, r in rows[k:j]])
            doc, row = np.array([d for d, _, _ in rows[k:j]], np.int64)[own], np.array([w for _, w, _ in rows[k:j]], np.int64)[own]
            both = gram ^ (full * np.uint64(_BASE))
            several = any(a[0] == b[0] and a[1] != b[1] for a, b in zip(rows[k:j], rows[k + 1 : j]))
            order = np.lexsort((row, at, doc, both)) if several else np.argsort(both, kind="stable")
            g, f = gram[order], full[order]
            new = np.append(True, (g[1:] != g[:-1]) | (f[1:] != f[:-1]))  # not by their mix alone
            first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
            done = np.zeros(len(order), bool)
            same = ~new & (doc[order] == doc[first]) & (at[order] == at[first])
            done[order] = ~new & ~same
            keep = np.zeros(len(order), bool)
            keep[order] = new | (same & np.append(False, row[order][1:] != row[order][:-1]))
            take = done | keep
            yield _frame(gram[take], full[take], doc[take], (at << 16 | left << 8 | right)[take], row[take], done[take])
            k = j


FOUND = "gram long, doc long, spot long, row long, open boolean"


def _settle(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Anchors sorted by gram, full, doc, spot, row: later ones of equal contexts are covered, first ones of grams with several contexts stay open."""
    gram0 = full0 = doc0 = spot0 = row0 = None  # the last row's gram, context and text, and that context's first row
    seen, waits = 0, []  # contexts of that gram so far; its only context's first rows, one a text

    for part in parts:
        over = part["done"].to_numpy()
        own = part[~over]
        gram, full, doc, spot, row = (own[c].to_numpy(np.int64) for c in ("gram", "full", "doc", "spot", "row"))
        n = len(own)
        cover_doc, cover_spot, cover_row = ([part[c].to_numpy(np.int64)[over]] for c in ("doc", "spot", "row"))
        open_rows = []
        if n:
            new_gram = np.append(gram0 is None or gram[0] != gram0, gram[1:] != gram[:-1])
            new_full = new_gram | np.append(full0 is None or full[0] != full0, full[1:] != full[:-1])
            first = np.maximum.accumulate(np.where(new_full, np.arange(n), -1))
            first_doc = np.where(first >= 0, doc[first], doc0 if doc0 is not None else 0)
            first_spot = np.where(first >= 0, spot[first], spot0 if spot0 is not None else 0)
            same = ~new_full & (doc == first_doc) & (spot == first_spot)
            again = ~new_full & ~same
            lead = new_full | (same & (row != np.append(row0 if row0 is not None else 0, row[:-1])))
            cover_doc.append(doc[again]), cover_spot.append(spot[again]), cover_row.append(row[again])
            group = np.cumsum(new_gram)  # 0 goes on with the last batch's gram
            contexts = np.bincount(group, new_full, minlength=group[-1] + 1).astype(np.int64)
            contexts[0] += seen if not new_gram[0] else 0
            at = lambda k: list(zip(gram[k].tolist(), doc[k].tolist(), spot[k].tolist(), row[k].tolist()))
            if waits and not new_gram[0] and contexts[0] >= 2:
                open_rows += waits
                waits = []
            open_rows += at(np.flatnonzero(lead & (contexts[group] >= 2)))
            if contexts[group[-1]] >= 2:
                waits = []
            else:
                waits = ([] if new_gram.any() else waits) + at(np.flatnonzero(lead & (group == group[-1])))
            seen = int(contexts[group[-1]])
            gram0, full0, doc0, spot0, row0 = int(gram[-1]), int(full[-1]), int(first_doc[-1]), int(first_spot[-1]), int(row[-1])
        doc, spot, row = np.concatenate(cover_doc), np.concatenate(cover_spot), np.concatenate(cover_row)
        if len(doc) or open_rows:
            more = np.array(open_rows, np.int64).reshape(-1, 4)
            yield pd.DataFrame(
                {
                    "gram": np.append(np.zeros(len(doc), np.int64), more[:, 0]),
                    "doc": np.append(doc, more[:, 1]),
                    "spot": np.append(spot, more[:, 2]),
                    "row": np.append(row, more[:, 3]),
                    "open": np.append(np.zeros(len(doc), bool), np.ones(len(more), bool)),
                }
            )


def common(sorted_rows: list[bytes]) -> list[int]:
    """Length of the common prefix of each row with the one before it; 0 for the first."""
    out = [0]
    for a, b in zip(sorted_rows, sorted_rows[1:]):
        n = min(len(a), len(b))
        if a[:n] != b[:n]:
            x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
            n -= (x.bit_length() + 7) // 8
        out.append(n)
    return out


def intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of every common-prefix interval at least `least` deep, by one scan with a stack; last is inclusive."""
    stack: list[tuple[int, int]] = []
    for i in range(1, len(lcp) + 1):
        depth = lcp[i] if i < len(lcp) else 0
        first = i - 1
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            yield d, first, i - 1
        if depth >= least and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def _best_earlier(order: list, lcp: list[int]) -> list[int]:
    """For each row of a sorted list, the longest common prefix with a row of lesser rank (order[i]); -1 if none."""
    best = [-1] * len(order)
    for way in (1, -1):
        stack: list[tuple[int, object]] = []  # (common length with the current row, rank), ranks falling towards the bottom
        walk = range(len(order)) if way == 1 else range(len(order) - 1, -1, -1)
        for i in walk:
            step = lcp[i] if way == 1 else (lcp[i + 1] if i + 1 < len(order) else 0)
            if stack:
                stack = [(min(c, step), r) for c, r in stack] if len(stack) < 64 else _shrink(stack, step)
            while stack and not stack[-1][1] < order[i]:
                stack.pop()
            if stack and stack[-1][0] > best[i]:
                best[i] = stack[-1][0]
            stack.append((1 << 30, order[i]))
    return best


def _shrink(stack: list, step: int) -> list:
    """Lower the common lengths; rows that fall to the same length and rank above another one are of no more use."""
    out: list = []
    for c, r in stack:
        c = min(c, step)
        while out and out[-1][0] >= c and not out[-1][1] < r:
            out.pop()
        if not out or out[-1][0] < c or out[-1][1] < r:
            out.append((c, r))
    return out


def maximal_repeats(rows: list[tuple], rights: list[bytes], lefts: list[bytes], width: int = WIDTH, gram: int = GRAM):
    """(depth, members, left lengths) of every maximal repeat group: an interval of the suffix array of `rights`, split by the
    reversed left contexts `lefts` wherever fewer than width - depth bytes go on to the left. The left length of a member is what
    it shares with some earlier member (rows gives the order), -1 if there is none."""
    sa = sorted(range(len(rows)), key=rights.__getitem__)
    for depth, a, b in intervals(common([rights[i] for i in sa]), gram):
        need = width - depth
        members = sorted(sa[a : b + 1], key=lefts.__getitem__)
        lcp = common([lefts[i] for i in members])
        k = 0
        while k < len(members):
            j = k + 1
            while j < len(members) and lcp[j] >= need:
                j += 1
            if j - k > 1:
                run = members[k:j]
                yield depth, run, _best_earlier([rows[i] for i in run], [0, *lcp[k + 1 : j]])
            k = j


COVERS = "doc long, start long, stop long, key long, gram long, row long"


def _cover(doc, start, stop, key, gram, row) -> pd.DataFrame:
    return pd.DataFrame({n: np.array(x, np.int64) for n, x in zip(("doc", "start", "stop", "key", "gram", "row"), (doc, start, stop, key, gram, row))})


def _windows(held: list[tuple], gram: int, out: list[tuple]) -> None:
    """A part of a frequent gram: windows met before in the part are covered, each other one goes on by its hash."""
    first: dict[int, tuple[int, int]] = {}
    sent: set[tuple[int, int]] = set()  # of the texts that have a window at its first place
    for doc, at, left, context, row in held:
        run = None
        for k in range(len(context) - WIDTH + 1):
            key, place = xxhash.xxh64_intdigest(context[k : k + WIDTH], 9) | 1, (doc, at - left + k)
            if first.get(key, place) < place:
                run = k if run is None else run
                continue
            if run is not None:
                out.append((doc, at - left + run, at - left + k - 1 + WIDTH, 0, 0, row))
                run = None
            if first.get(key) != place or (key, row) not in sent:  # else met through another anchor of the same window
                first[key] = place
                sent.add((key, row))
                out.append((*place, place[1] + WIDTH, key - (1 << 64) if key >> 63 else key, gram, row))
        if run is not None:
            out.append((doc, at - left + run, at - left + len(context), 0, 0, row))


def _tree(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Contexts sorted by gram and part, then doc and spot -> covers (key 0); of frequent grams also windows (key: the window's hash)."""
    now, held, out = None, [], []

    def close():
        if now is not None and now[2]:
            _windows(held, now[0], out)
        elif len(held) > 1:
            rights, lefts = [c[x:] for _, _, x, c, _ in held], [c[:x][::-1] for _, _, x, c, _ in held]
            for depth, run, best in maximal_repeats([h[:2] for h in held], rights, lefts):
                for i, left in zip(run, best):
                    if left >= 0 and left + depth >= WIDTH:
                        out.append((held[i][0], held[i][1] - left, held[i][1] + depth, 0, 0, held[i][4]))

    for part in parts:
        rows = zip(part["gram"].tolist(), part["part"].tolist(), part["frequent"].tolist(), part["doc"].tolist(), part["spot"].tolist(), part["context"], part["row"].tolist() if "row" in part else [0] * len(part))
        for g, share, frequent, doc, spot, context, row in rows:
            if (g, share, frequent) != now:
                close()
                now, held = (g, share, frequent), []
            held.append((doc, spot >> 16, spot >> 8 & 255, context, row))
        if out:
            yield _cover(*zip(*out))
            out.clear()
    close()
    if out:
        yield _cover(*zip(*out))


def _contexts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(raw, wanted: [(gram, spot, part, frequent)], doc, row) -> one row a wanted anchor with the bytes of its context."""
    for part in parts:
        rows = []
        for doc, row, raw, wanted in zip(part["doc"].tolist(), part["row"].tolist(), part["raw"], part["wanted"]):
            for w in wanted:
                g, s = w["gram"], w["spot"]
                at = s >> 16
                rows.append((g, w["part"], w["frequent"], doc, s, bytes(raw[at - (s >> 8 & 255) : at + (s & 255)]), row))
        if rows:
            yield pd.DataFrame(rows, columns=["gram", "part", "frequent", "doc", "spot", "context", "row"])


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, doc (doc_id, null as the least long), row, raw (the text's bytes). row tells the texts of one doc apart: their hash,
    or 0 where a doc has one text only."""
    raw = small_batches(docs).select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("raw"))
    texts = raw.groupBy("doc").agg(F.min(F.xxhash64("raw")).alias("low"), F.max(F.xxhash64("raw")).alias("high"))
    several = written(texts.where("low <> high").select(F.col("doc").alias("_doc")), "several")
    raw = raw.join(several, F.col("doc") == F.col("_doc"), "left")
    return raw.select("doc_id", "doc", F.when(F.col("_doc").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64("raw")).alias("row"), "raw")


def covers(raw: DataFrame) -> DataFrame:
    """(doc, row, start, stop): byte spans that together are exactly what an earlier start repeats, from the rows of keyed()."""
    raw = raw.select("doc", "row", "raw")
    marks = raw.where(F.length("raw") >= WIDTH).mapInPandas(_emit, ANCHORS)
    dealt = F.when(F.col("done"), F.xxhash64("doc", "spot")).otherwise(F.col("gram"))  # what a batch has settled can go anywhere
    sorted_marks = marks.withColumn("deal", dealt).repartition("deal").drop("deal").sortWithinPartitions("gram", "full", "doc", "spot", "row")
    found = written(sorted_marks.mapInPandas(_settle, FOUND), "anchors")
    whole = found.where("not open").select(
        "doc", "row", (F.shiftright("spot", 16) - F.shiftright("spot", 8).bitwiseAND(255)).alias("start"), (F.shiftright("spot", 16) + F.col("spot").bitwiseAND(255)).alias("stop")
    )
    many = found.where("open").groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > MANY).select(F.col("gram").alias("_g"), F.ceil(F.col("n") / MANY).alias("parts"))
    many = written(many, "many")  # a row for MANY anchors at most: its size decides the join, so a frequent gram is no hot group
    opened = found.where("open").join(many, F.col("gram") == F.col("_g"), "left")
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc", "spot"), F.col("parts"))).cast("int")
    opened = opened.select("doc", "row", F.struct("gram", "spot", part.alias("part"), F.col("parts").isNotNull().alias("frequent")).alias("w"))
    wanted = opened.groupBy("doc", "row").agg(F.collect_set("w").alias("wanted"))
    contexts = raw.join(wanted.hint("shuffle_hash"), ["doc", "row"]).mapInPandas(_contexts, "gram long, part int, frequent boolean, doc long, spot long, context binary, row long")
    near = contexts.repartition("gram", "part").sortWithinPartitions("gram", "part", "doc", "spot")
    deeper = written(near.mapInPandas(_tree, COVERS), "covers")
    windows = deeper.where("key <> 0").withColumn("place", F.struct("doc", "start"))
    first = windows.groupBy("gram", "key").agg(F.min("place").alias("first"))
    later = windows.join(first, ["gram", "key"]).where("place <> first")
    return whole.unionByName(deeper.where("key = 0").select("doc", "row", "start", "stop")).unionByName(later.select("doc", "row", "start", "stop"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of spans as maximal runs, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def removed(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs(doc_id, text) with kept (the remaining bytes), n_bytes, n_removed, n_spans; texts are shuffled by doc_id."""
    raw = keyed(docs, text)
    spans = covers(raw).groupBy("doc", "row").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))

    @pandas_udf("kept binary, n_removed long, n_spans long")
    def cut(raws: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for r, s in zip(raws, spans):
            runs = merged([(x["start"], x["stop"]) for x in s]) if s is not None else []
            edge = [0, *(e for run in runs for e in run), len(r)]
            rows.append((b"".join(r[a:b] for a, b in zip(edge[::2], edge[1::2])), sum(b - a for a, b in runs), len(runs)))
        return pd.DataFrame(rows, columns=["kept", "n_removed", "n_spans"])

    both = raw.join(spans.hint("shuffle_hash"), ["doc", "row"], "left").withColumn("cut", cut.asNondeterministic()("raw", "spans"))
    return both.select("doc_id", F.length("raw").cast("long").alias("n_bytes"), F.col("cut.n_removed").alias("n_removed"), F.col("cut.n_spans").alias("n_spans"), F.col("cut.kept").alias("kept"))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return removed(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
