"""Near-duplicate classes: Order MinHash candidates, verified by banded alignment.

Texts are sequences of five-word shingles over lower-cased words of letters and digits. Two texts are linked when
M / (m + n - M) >= 0.8, where M is the longest common subsequence of their m and n shingles: the Jaccard similarity of
the shingles that align in order. Classes are the connected texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.ordering import carried, runs
from codestrata.session import stage

WORDS = 5
SIMILAR = 0.8
BANDS, MINIMA = 24, 4
#: Texts of so few shingles need single-minimum keys too, four of a handful collide too seldom; so all that can be linked to them have some.
FEW = 25
_KEYED = int(FEW / SIMILAR) + 1
#: Words that a task holds of a set at once; one longer text is held alone.
PART_WORDS = 1 << 20
_PIECE = 8 << 20
_SURVIVORS = 24
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _B
    return h ^ (h >> np.uint64(29))


def pieces(texts: pa.Array):
    """(first, past) of runs of texts of a few megabytes, one text at least."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(size) - size) // _PIECE
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(size)]
    return [(a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a]


def normal(texts: pa.Array) -> tuple[list[bytes | None], np.ndarray, np.ndarray]:
    """Keys of the texts, the 32-bit hashes of all their words, and how many each has.

    Texts of the same words share a key; a text without words has one of its own spelling, a null text none.
    """
    import xxhash

    plain = pc.ascii_trim_whitespace(pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}\p{N}]+", " "))
    split = pc.ascii_split_whitespace(pc.cast(plain, pa.large_string()))
    size = np.diff(split.offsets.to_numpy())
    flat = split.flatten()
    empty = pc.equal(flat, "").to_numpy(zero_copy_only=False)
    wordless = pc.equal(plain, "").to_numpy(zero_copy_only=False)
    if empty.any():
        flat, size = flat.filter(pa.array(~empty)), np.where(wordless, 0, size)
    coded = flat.dictionary_encode()
    table = np.fromiter((xxhash.xxh3_64_intdigest(w) & 0xFFFFFFFF for w in coded.dictionary.to_pylist()), np.uint32, len(coded.dictionary))
    hashes = table[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.uint32)
    keys = [None if t is None else xxhash.xxh3_128_digest(b"\x00" + t.encode() if bare else p.encode())
            for t, p, bare in zip(texts.to_pylist(), plain.to_pylist(), wordless.tolist(), strict=True)]
    return keys, hashes, size


def shingles(words: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles and how many each text has; a text of fewer than five words has one."""
    wide = np.where(size > 0, np.maximum(size, WORDS), 0)
    begin = np.cumsum(wide) - wide
    padded = np.zeros(int(wide.sum()) + WORDS, np.uint64)
    padded[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(len(words))] = words.astype(np.uint64) + np.uint64(1)
    count = np.maximum(wide - WORDS + 1, 0)
    at = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    h = np.full(len(at), _A, np.uint64)
    for k in range(WORDS):
        h = _mix((h ^ padded[at + k]) * _A)
    return h, count


def sketches(h: np.ndarray, count: np.ndarray, bands: int = BANDS, minima: int = MINIMA) -> list[np.ndarray]:
    """Order MinHash keys of each text: per band, its `minima` smallest occurrence-labelled shingles in text order."""
    n = len(count)
    text = np.repeat(np.arange(n), count)
    together = np.argsort(_mix(h ^ (text.astype(np.uint64) * _A)), kind="stable")
    same = np.zeros(len(h), bool)
    same[1:] = (h[together][1:] == h[together][:-1]) & (text[together][1:] == text[together][:-1])
    place = np.arange(len(h))
    occurrence = np.empty(len(h), np.int64)
    occurrence[together] = place - np.maximum.accumulate(np.where(same, 0, place))
    labelled = np.where(occurrence > 0, _mix(h + occurrence.astype(np.uint64) * _A), h)
    share = np.minimum(1.0, _SURVIVORS / np.maximum(count, 1))
    limit = np.where(share < 1, (share * 2.0**64 * (1 - 1e-9)), 0).astype(np.uint64) - np.uint64(1)  # 0 - 1: everything
    out = np.empty((n, 2 * bands), np.int64)
    for band in range(bands):
        v = _mix((labelled ^ np.uint64((band * 2 + 1) * 0x632BE59BD9B4E019 & (2**64 - 1))) * _A)
        some = v <= limit[text]
        short = np.bincount(text[some], minlength=n) < np.minimum(count, minima)
        if short.any():
            some |= short[text]
        at = np.flatnonzero(some)
        at = at[np.lexsort((v[at], text[at]))]
        start = np.searchsorted(text[at], np.arange(n), "left")
        rank = np.arange(len(at)) - start[text[at]]
        alone = np.zeros(n, np.uint64)
        alone[text[at[rank == 0]]] = labelled[at[rank == 0]]
        at = np.sort(at[rank < minima])
        start = np.searchsorted(text[at], np.arange(n), "left")
        rank = np.arange(len(at)) - start[text[at]]
        kept = np.zeros((n, minima), np.uint64)
        kept[text[at], rank] = labelled[at]
        key = np.full(n, band + 1, np.uint64) * _A
        for k in range(minima):
            key = _mix((key ^ kept[:, k]) * _A)
        out[:, band] = key.view(np.int64)
        out[:, bands + band] = _mix((alone ^ np.uint64(band + 1001)) * _B).view(np.int64)
    return [out[i, : bands * (1 + (count[i] <= _KEYED))] if count[i] else out[i, :0] for i in range(n)]


def _sketcher(batches):
    for batch in batches:
        for a, b in pieces(batch.column(1)):
            keys, words, size = normal(batch.column(1).slice(a, b - a))
            h, count = shingles(words, size)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(keys, pa.binary()),
                pa.array(count.astype(np.int32)), pa.array(sketches(h, count), pa.list_(pa.int64())),
            ], names=["doc_id", "spelling", "node", "n", "keys"])


def _sequencer(batches):
    """node and words (32-bit hashes) of every text."""
    for batch in batches:
        for a, b in pieces(batch.column(0)):
            keys, words, size = normal(batch.column(0).slice(a, b - a))
            end = np.cumsum(size)
            yield pa.RecordBatch.from_arrays([
                pa.array(keys, pa.binary()), pa.array([words[e - s : e].tobytes() for s, e in zip(size, end, strict=True)], pa.binary()),
            ], names=["node", "words"])


def aligned(a: np.ndarray, b: np.ndarray, least: float) -> int:
    """The longest common subsequence, or any smaller number where it is below `least`.

    Equal ends go first, then a multiset bound. The rest is aligned within the band that at least `least` matches leave, one bit
    vector of the band's width a row: the vector is shifted along the diagonal, and what falls off its end is counted. So
    time is the length times the band, and memory the length.
    """
    m = min(len(a), len(b))
    differ = np.flatnonzero(a[:m] != b[:m])
    head = int(differ[0]) if len(differ) else m
    a, b = a[head:], b[head:]
    m = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - m :][::-1] != b[len(b) - m :][::-1])
    tail = int(differ[0]) if len(differ) else m
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    done = head + tail
    if not len(a) or not len(b):
        return done
    shared, at, counts = np.unique(a, return_inverse=True, return_counts=True)
    place = np.minimum(np.searchsorted(shared, b), len(shared) - 1)
    held = shared[place] == b
    most = np.minimum(np.bincount(place[held], minlength=len(shared)), counts).sum()
    if done + most < least:
        return done
    width = max(0, int(len(a) + len(b) - 2 * max(0.0, least - done)))
    order = np.argsort(at, kind="stable")
    ends = np.cumsum(counts)
    places = order.tolist()
    upto = (ends - counts).tolist()  # per symbol, the first of its places that has not entered the band
    last, seen, since = ends.tolist(), [0] * len(shared), [0] * len(shared)
    full = (1 << (2 * width + 1)) - 1
    v, base, matched = full, 0, 0  # bit i stands for a[base + i]; a cleared bit is a match
    for j in np.flatnonzero(held).tolist():
        k, low, high = place[j], max(0, j - width), j + width
        if low > base:
            gone = low - base
            matched += gone - (v & ((1 << gone) - 1)).bit_count() if gone <= 2 * width else 2 * width + 1 - v.bit_count()
            v = (v >> gone) | (full & ~(full >> gone)) if gone <= 2 * width else full
            base = low
        inside = seen[k] >> (base - since[k])
        next_, stop = upto[k], last[k]
        while next_ < stop and places[next_] <= high:
            if places[next_] >= base:
                inside |= 1 << (places[next_] - base)
            next_ += 1
        upto[k], seen[k], since[k] = next_, inside, base
        u = v & inside
        if u:
            v = ((v + u) | (v - u)) & full
    return done + matched + 2 * width + 1 - v.bit_count()


def _least(m, n):
    """The matches that two texts of m and n shingles need."""
    return SIMILAR / (1 + SIMILAR) * (m + n)


def _cut(words: bytes) -> np.ndarray:
    words = np.frombuffer(words, np.uint32)
    return shingles(words, np.array([len(words)]))[0]


def _verifier(batches):
    """x, y and linked."""
    for batch in batches:
        verdicts = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            a, b = _cut(x), _cut(y)
            least = _least(len(a), len(b))
            verdicts.append(aligned(a, b, least) >= least - 1e-9)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(verdicts, pa.bool_())], names=["x", "y", "linked"])


def _verified(pairs: DataFrame, sequences: DataFrame) -> DataFrame:
    """The pairs (x, y) with the verdict of the alignment, staged."""
    text = lambda c: sequences.select(F.col("node").alias(c), F.col("words").alias(f"{c}_words"))
    both = pairs.select("x", "y").join(text("x"), "x").join(text("y"), "y").select("x", "y", "x_words", "y_words")
    return stage(both.mapInArrow(_verifier, "x binary, y binary, linked boolean"), "verified")


def meet(texts: list[np.ndarray], comp: np.ndarray, main: np.ndarray, side: np.ndarray) -> tuple[list[tuple[int, int]], int]:
    """Links (x, y) that connect the classes `comp` of texts (their shingles) as all similar pairs would, and how many were aligned.

    A pair can only be linked if it shares four fifths of the longer text's shingles. So of each text's shingles, rarest of the
    run first, a fifth and one lead to all partners; what a candidate shares bounds its matches, and only pairs that
    pass and are not in one class by then are aligned. Texts of the class `main` need not meet each other, and with
    two sides only pairs across them do.
    """
    size = np.array([len(t) for t in texts], np.int64)
    values, codes = np.unique(np.concatenate(texts), return_inverse=True)
    entry, uses = np.unique(np.repeat(np.arange(len(texts)), size) * len(values) + codes, return_counts=True)
    text, code = entry // len(values), entry % len(values)
    holders = np.bincount(code, minlength=len(values))
    order = np.lexsort((code, holders[code], text))
    text, code, uses = text[order], code[order], uses[order]
    first = np.searchsorted(text, np.arange(len(texts) + 1))
    before = np.cumsum(uses) - uses
    before -= before[first[:-1]][text]
    lead = before <= size[text] - np.ceil(SIMILAR * size[text] - 1e-9)
    by_code = np.argsort(code[lead], kind="stable")
    led_text = text[lead][by_code]
    led = np.searchsorted(code[lead][by_code], np.arange(len(values) + 1))
    root = np.unique(comp, return_inverse=True)[1]
    two, links, tried = bool((side != side[0]).any()), [], 0
    mine = np.zeros(len(values), np.int64)
    for x in np.flatnonzero(~main).tolist():
        span = slice(first[x], first[x + 1])
        ahead = code[span][lead[span]]
        others = np.unique(np.concatenate([led_text[led[c] : led[c + 1]] for c in ahead.tolist()]))
        fits = (root[others] != root[x]) & (size[others] >= SIMILAR * size[x] - 1e-6) & (size[x] >= SIMILAR * size[others] - 1e-6)
        fits &= main[others] | (others > x)
        if two:
            fits &= side[others] != side[x]
        others = others[fits]
        if not len(others):
            continue
        mine[code[span]] = uses[span]
        spans = [slice(first[y], first[y + 1]) for y in others.tolist()]
        shared = np.array([int(np.minimum(mine[code[s]], uses[s]).sum()) for s in spans])
        mine[code[span]] = 0
        good = shared >= _least(size[x], size[others]) - 1e-9
        # The nearest first: its class is then known, and the rest of it passed over.
        for y in others[good][np.argsort(-shared[good], kind="stable")].tolist():
            if root[y] != root[x]:
                tried += 1
                least = _least(size[x], size[y])
                if aligned(texts[x], texts[y], least) >= least - 1e-9:
                    links.append((x, y))
                    root[root == root[y]] = root[x]
    return links, tried


def _meeter(batches):
    """x and y of the links that the texts of every run add."""
    for run in runs(batches, 3):
        if run.num_rows < 2:
            continue
        nodes = run.column("node").to_pylist()
        comp = np.unique(np.array(run.column("comp").to_pylist(), object), return_inverse=True)[1]
        main, side = (run.column(c).to_numpy() for c in ("main", "side"))
        links, _ = meet([_cut(w) for w in run.column("words").to_pylist()], comp, main, side)
        if links:
            x, y = zip(*links, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in x], pa.binary()), pa.array([nodes[i] for i in y], pa.binary())], names=["x", "y"])


def _met(shared: DataFrame, comps: DataFrame, sequences: DataFrame) -> DataFrame:
    """Links (x, y) between the classes that still share a bucket, staged.

    Classes that share buckets form sets. The texts of a set, each once, go to one task, or, beyond `PART_WORDS`, are dealt
    into parts: those of its largest class and the others. A part of the others meets all parts, so the largest class, which may be
    most of a hot group, is sent only as often as the others have parts, and its parts do not meet each other.
    """
    placed = shared.join(comps, "node", "left").select("bucket", "node", "leader", F.coalesce("comp", "node").alias("comp"))
    # A bucket's classes are joined through its leader's: the buckets of a hot group have one leader, so a class has few of these edges.
    center = F.max(F.when(F.col("node") == F.col("leader"), F.col("comp"))).alias("center")
    several = placed.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("top"), center).where("low <> top").select("bucket", "center")
    open_ = stage(placed.join(several, "bucket").select("node", "comp", "center").distinct(), "open")
    sets = components(open_.where("comp <> center").select(F.col("comp").alias("x"), F.col("center").alias("y")).distinct())
    members = open_.select("node", "comp").distinct().join(sets.select(F.col("node").alias("comp"), F.col("comp").alias("set")), "comp")
    members = members.join(sequences.select("node", (F.octet_length("words") / 4).cast("long").alias("n")), "node")
    members = stage(members, "members")
    each = members.groupBy("set", "comp").agg(F.sum("n").alias("n"))
    whole = each.groupBy("set").agg(F.sum("n").alias("n"), F.max(F.struct("n", "comp")).alias("most"))
    count = lambda n: F.greatest(F.lit(1), F.ceil(n / PART_WORDS)).cast("int")
    whole = whole.select("set", F.col("most.comp").alias("largest"), (F.col("n") > PART_WORDS).alias("split"),
                         count(F.col("most.n")).alias("mains"), count(F.col("n") - F.col("most.n")).alias("others"))
    dealt = members.join(stage(whole, "sets"), "set").withColumn("main", F.col("comp") == F.col("largest"))
    part = F.pmod(F.xxhash64("node"), F.when(F.col("main"), F.col("mains")).otherwise(F.col("others"))).cast("int")
    side = F.when(~F.col("split"), 0).when(F.col("main"), part).otherwise(F.col("mains") + part)
    beside = F.when(~F.col("split"), F.array(F.lit(0))).otherwise(F.sequence(F.when(F.col("main"), F.col("mains")).otherwise(0), F.col("mains") + F.col("others") - 1))
    dealt = dealt.withColumn("side", side).join(sequences, "node").withColumn("other", F.explode(beside))
    dealt = dealt.select("set", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "node", "comp", "main", "side", "words")
    dealt = dealt.repartition("set", "low", "high").sortWithinPartitions("set", "low", "high")
    return stage(dealt.mapInArrow(_meeter, "x binary, y binary"), "met")


def _rooted(tree: DataFrame) -> DataFrame:
    """(node, parent) of a forest to (node, comp): parents double their reach until all are roots."""
    now = stage(tree.select("node", F.col("parent").alias("comp")), "forest")
    while True:
        up = now.select(F.col("node").alias("p"), F.col("comp").alias("next"))
        raised = stage(now.join(up, now["comp"] == up["p"], "left").select("node", F.coalesce("next", "comp").alias("comp"), F.col("next").isNotNull().alias("moved")), "forest")
        if not raised.where("moved").limit(1).count():
            return raised.select("node", "comp")
        now = raised.select("node", "comp")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp), staged: the least node that edges (x, y) connect each node with.

    Rounds of least neighbours with pointer jumping, as joins and partial aggregates; a hub is split like any hot key.
    """
    both = stage(edges.select("x", "y").union(edges.select("y", "x")).distinct(), "edges")
    now = both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("least")).select("node", F.least("node", "least").alias("comp"))
    now = stage(now, "components")
    while True:
        seen = now.select(F.col("node").alias("y"), F.col("comp").alias("beside"))
        near = both.join(seen, "y").groupBy(F.col("x").alias("node")).agg(F.min("beside").alias("beside"))
        lower = now.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "beside").alias("comp"))
        up = lower.select(F.col("node").alias("p"), F.col("comp").alias("next"))
        raised = stage(lower.join(up, F.col("comp") == F.col("p"), "left").select(
            "node", F.coalesce("next", "comp").alias("comp"), "old"), "components")
        if not raised.where("comp <> old").limit(1).count():
            return raised.select("node", "comp")
        now = raised.select("node", "comp")


def _joined(comps: DataFrame, links: DataFrame) -> DataFrame:
    """The components (node, comp; others are their own) after further links (x, y) between their nodes."""
    of = lambda c, out: comps.select(F.col("node").alias(c), F.col("comp").alias(out))
    ends = links.join(of("x", "cx"), "x", "left").join(of("y", "cy"), "y", "left")
    ends = stage(ends.select(F.coalesce("cx", "x").alias("x"), F.coalesce("cy", "y").alias("y")).where("x <> y").distinct(), "links")
    if ends.isEmpty():
        return comps
    merged = components(ends).select(F.col("node").alias("was"), F.col("comp").alias("is"))
    moved = comps.join(merged, F.col("comp") == F.col("was"), "left").select("node", F.coalesce("is", "comp").alias("comp"))
    new = merged.join(comps.select("node"), F.col("was") == F.col("node"), "left_anti").select(F.col("was").alias("node"), F.col("is").alias("comp"))
    return stage(moved.unionByName(new), "components")


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, spelling (a hash of the text), node (the text's key) and comp (the class's key) of every row.

    Copies, the same words in any case and punctuation, share a node and are compared once. Order MinHash keys put texts
    into buckets; a bucket's leader is the member whose buckets hold most, so one near the middle of its group. First
    each text meets the best leader of all its buckets; alignment links it or not. Texts of buckets that then still hold several
    classes meet in sets (`_met`), where only pairs that share enough shingles are aligned. So a hot group costs an
    alignment or two a member, no pair of a group is made as a row, and every similar pair that shares a bucket
    is linked or connected: two texts of similarity 0.8 miss all buckets with odds near 3 in a million.

    A text of any length is one row, aligned in time of its length times the band. A null text has neither node nor comp. Texts without words are copies only of their own spelling. Repeated rows
    and ids are rows like others. An empty table gives no rows. Other columns are not read.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("t"), F.xxhash64(F.col(f"`{text}`")).alias("spelling"))
    id_type = dict(rows.dtypes)["doc_id"]
    sketched = stage(rows.mapInArrow(_sketcher, f"doc_id {id_type}, spelling long, node binary, n int, keys array<long>"), "sketches")
    nodes = sketched.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("keys").alias("keys"))
    nodes = stage(nodes, "texts")
    members = nodes.select(F.explode("keys").alias("bucket"), "node", "n")
    several = stage(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), "buckets")
    held = stage(members.join(several, "bucket"), "held")
    standing = stage(held.groupBy("node").agg(F.sum("rows").alias("score")), "standing")
    leaders = held.join(standing, "node").groupBy("bucket").agg(F.max(F.struct("score", "node", F.col("n").alias("m"))).alias("l"))
    shared = stage(held.drop("rows").join(leaders, "bucket").select("bucket", "node", "n", F.col("l.node").alias("leader"), F.col("l.m").alias("m"), F.col("l.score").alias("l_score")), "shared")
    fits = (F.col("n") >= SIMILAR * F.col("m") - 1e-6) & (F.col("m") >= SIMILAR * F.col("n") - 1e-6)
    # Both sides are shuffled at every size: the texts that share no bucket fall before the rest is grouped.
    sequences = rows.select("t").mapInArrow(_sequencer, "node binary, words binary").join(standing.select("node").hint("merge"), "node", "left_semi")
    sequences = stage(sequences.groupBy("node").agg(F.first("words").alias("words")), "sequences")
    first = shared.where(fits & (F.col("node") != F.col("leader"))).groupBy(F.col("node").alias("x")).agg(F.max(F.struct("l_score", "leader")).alias("l")).select("x", F.col("l.leader").alias("y"))
    trees = _verified(first, sequences).where("linked").select(F.col("x").alias("node"), F.col("y").alias("parent"))
    comps = _rooted(trees)
    comps = _joined(comps, _met(shared.select("bucket", "node", "leader"), comps, sequences))
    found = comps.withColumnRenamed("node", "of")
    out = sketched.select("doc_id", "spelling", "node").join(found, F.col("node") == F.col("of"), "left")
    return out.select("doc_id", "spelling", "node", F.coalesce("comp", "node").alias("comp"))


def labelled(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and class_id of every row: the smallest id of its class. A null text is a class of its own."""
    rows = classes(docs, id_col, text)
    least = rows.where("comp is not null").groupBy(F.col("comp").alias("of")).agg(F.min("doc_id").alias("least"))
    return rows.join(least, F.col("comp") == F.col("of"), "left").select("doc_id", F.when(F.col("of").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("class_id"))


def one_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class with its columns as they were: that of the smallest id, and every row with a null text.

    Of rows with the same id and text in one class one stays, whichever comes first.
    """
    rows = classes(docs, id_col, text).where("comp is not null").groupBy("doc_id", "spelling", "comp").count()
    rows = stage(rows, "class-rows")
    kept = rows.groupBy("comp").agg(F.min(F.struct("doc_id", "spelling", "count")).alias("k")).select(
        F.col("k.doc_id").alias("k_id"), F.col("k.spelling").alias("k_spelling"), F.col("k.count").alias("k_count"))
    kept = stage(kept, "kept")
    body = docs.select(carried(docs), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").isNull().alias("bare"), F.xxhash64(F.col(f"`{text}`")).alias("spelling"))
    texts = body.where("not bare").join(kept, F.col("id").eqNullSafe(F.col("k_id")) & (F.col("spelling") == F.col("k_spelling")))
    out = body.where("bare").select("row").unionByName(texts.where("k_count = 1").select("row"))
    if kept.where("k_count > 1").limit(1).count():
        out = out.unionByName(texts.where("k_count > 1").dropDuplicates(["id", "spelling"]).select("row"))
    return out.select("row.*")
