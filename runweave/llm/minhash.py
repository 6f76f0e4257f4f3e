"""MinHash near-duplicates by a signature-coordinate inverted join.

Documents with equal shingle sets form a class, and only classes go on.  A class's signature is a set of COORDS pairs of
a coordinate and its value.  Two classes are compared if at least `least_matches` of their pairs coincide, so of each class
only a prefix needs to be posted: its pairs in one order, rarest first, but for the last `least_matches - 1`.  Two classes with
that many pairs in common share one of their prefixes' pairs for certain; pairs that a single class has take places of the
prefix and need no list, so most classes without company are posted nowhere.  Lists are kept by set size, and what is too
small or too large for the threshold is skipped; of what meets, the coinciding pairs are counted over the whole signature.
At similarity 0.8, 4e-6 of the links are lost that way, fewer above; what remains is decided on the full shingle sets.
`exact=True` posts the rarest shingles themselves, as many as the threshold asks for, and loses none.

Only components are asked for, so a link inside a component that is already known need not be looked at:

1. Each list has a hub, the class with most company.  Each class is compared with the hub that it matches best.
2. Classes that still match one of another component are involved; those that meet in lists form groups.
3. The full sets of a group's members are dealt over as many tasks as their size asks for; each member outside the group's
   largest component visits all of these, where its intersections with all members are counted.  A task joins components as
   it finds links, so it returns fewer links than it has members.

No list or group is held by one task: hubs come from an aggregate, and members are dealt by size.  Texts move once into a
table of what has company, and once to the hub or the group that they are compared in.
"""

from __future__ import annotations

from math import comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runweave.llm.common import documents, drop_table, stage_table
from runweave.llm.substring_dedup import FIRST, gram_hashes, mix, word_hashes
from runweave.llm.token_ids import forget_encoders, parts_of, slices

COORDS = 64
LOSS = 5e-6  # share of the links at the threshold that signatures may miss
CHUNK = 4096  # members of a list that one task compares
CHUNK_SHINGLES = 1 << 17  # of a group's sets that one task holds, about
HUB_SALTS = 500  # members that one task compares with a hub, about
HEAVY = 4096  # classes with over 1 / HEAVY of all rows are joined by a broadcast: there are fewer than HEAVY
MARKS = 1 << 19  # 64-bit words of a filter, at most, whatever the input's size
SIGNATURE_SEED = 20260101


def least_matches(threshold: int) -> int:
    """The most coinciding coordinates that all but LOSS of the pairs at the threshold have."""
    s, below = threshold / 100, 0.0
    for m in range(COORDS + 1):
        below += comb(COORDS, m) * s**m * (1 - s) ** (COORDS - m)
        if below > LOSS:
            return m
    return COORDS


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of a text with A-Z in lower case; of all its words if they are fewer."""
    words = word_hashes((text or "").encode().lower())
    return np.unique(gram_hashes(words, min(k, len(words)))) if len(words) else words


def _rows(seed: int = SIGNATURE_SEED) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, COORDS, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, COORDS, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """COORDS minima of the set under as many hash functions, reduced to 32 bits."""
    (a, b), best = _rows(), np.full(COORDS, ~np.uint64(0))
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 2048):
            best = np.minimum(best, (shingles[None, at : at + 2048] * a[:, None] + b[:, None]).min(axis=1))
    return (mix(best) >> np.uint64(32)).astype(np.uint32)


def matches(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Coinciding bytes of the rows of a and of b."""
    return np.count_nonzero(a == b, axis=-1)


def _keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.coalesce(F.col(key).cast("long"), F.lit(FIRST)).alias("k"), F.xxhash64(text).alias("th"), F.col(text).alias("t"))


def _marked(rows: DataFrame, row_hash: Column, some: DataFrame, some_hash: Column, how: str) -> DataFrame:
    """Rows whose hash may be one of some's ("left_semi"), and those whose hash certainly isn't ("left_anti"): one bit a hash, in
    a table of at most MARKS rows that is broadcast.  More hashes mean more rows that may be meant by mistake, so an exact
    join follows; it only spares texts the way through an exchange."""
    word, bit = (lambda h: F.pmod(h, F.lit(MARKS))), (lambda h: F.shiftrightunsigned(h, 58).cast("int"))
    marks = some.select(word(some_hash).alias("_rw_word"), bit(some_hash).alias("bit")).groupBy("_rw_word").agg(F.bit_or(F.expr("1L << bit")).alias("_rw_bits"))
    met = (word(row_hash) == marks["_rw_word"]) & (F.getbit(marks["_rw_bits"], bit(row_hash)) == 1)
    return rows.join(F.broadcast(marks), met, how)


def _signed(docs: DataFrame, k: int) -> DataFrame:
    """k, th, n (set size), f1 and f2 (fingerprint of the set), mins (COORDS 32-bit integers) and sig (a byte of each)."""

    def run(batches):
        forget_encoders()
        for batch in batches:
            for part in slices(batch):
                rows = []
                for t in part.column(2).to_pylist():
                    s = shingle_set(t, k)
                    sig = signature(s)
                    with np.errstate(over="ignore"):
                        f1, f2 = mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
                    rows.append((len(s), int(f1.view(np.int64)), int(f2.view(np.int64)), sig.astype("<u4").tobytes(), sig.astype(np.uint8).tobytes()))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds))], names=["k", "th", "n", "f1", "f2", "mins", "sig"])

    return docs.mapInArrow(run, "k long, th long, n long, f1 long, f2 long, mins binary, sig binary")


def _signature_pairs(classes: DataFrame) -> DataFrame:
    """cid, token: a class's pairs of coordinate and value."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1024):
                mins = np.frombuffer(b"".join(part.column(1).to_pylist()), "<u4").astype(np.int64).reshape(-1, COORDS)
                token = mins | np.arange(COORDS, dtype=np.int64) << 32
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(part.column(0)), COORDS)), pa.array(token.ravel())], names=["cid", "token"])

    return classes.select("cid", "mins").mapInArrow(run, "cid long, token long")


def _shingle_pairs(classes: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """cid, token: a class's shingles."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                for cid, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    own = shingle_set(t, k).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), cid, np.int64)), pa.array(own)], names=["cid", "token"])

    return texts.select("cid", "t").mapInArrow(run, "cid long, token long")


def _prefixes(classes: DataFrame, tokens: DataFrame, size, prefix) -> DataFrame:
    """cid, n, company, lists: of each class's tokens in the order of frequency, those of its first `prefix` that others have too.

    `size`: tokens that a class has in all."""
    counts = stage_table(tokens.groupBy("token").agg(F.count("*").alias("freq")).filter("freq > 1"), "token-counts")
    shared = tokens.join(counts, "token").groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("freq", "token"))).alias("all"))
    room = (prefix - size + F.size("all")).cast("int")
    first = F.slice("all", 1, F.greatest(room, F.lit(0)))
    out = shared.join(classes.select("cid", "n"), "cid").withColumn("first", first).filter(F.size("first") > 0)
    out = stage_table(out.select("cid", "n", F.aggregate("first", F.lit(0).cast("long"), lambda x, y: x + y["freq"]).alias("company"), F.col("first.token").alias("lists")), "prefixes")
    drop_table(counts)
    return out


def _postings(prefixes: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """list, cid, n, company of the members of lists that have another one there whose size may reach the threshold; and a table to
    drop once they are written.  Steps of size are wide enough that what may link is at most one step apart.  A list has a count
    for each step only, so long ones are summed before they move."""
    step = F.floor(F.log(F.col("n").cast("double")) / max(1.001 * log(100 / max(threshold, 1)), 0.001))
    posted = prefixes.select("cid", "n", "company", step.alias("step"), F.explode("lists").alias("list"))
    counts = posted.groupBy("list", "step").agg(F.count("*").alias("members"))
    lists = counts.groupBy("list").agg(F.collect_list(F.struct("step", "members")).alias("steps"))
    lists = stage_table(lists.filter((F.size("steps") > 1) | (F.col("steps")[0]["members"] > 1)), "lists")
    company = F.exists("steps", lambda x: (F.abs(x["step"] - F.col("step")) == 1) | (x["step"] == F.col("step")) & (x["members"] > 1))
    return posted.join(lists, "list").filter(company).select("list", "cid", "n", "company"), lists


def _similar(part: pa.RecordBatch, names: tuple[str, str], sizes: tuple[str, str], threshold: int, least: int) -> tuple[pa.RecordBatch, np.ndarray]:
    """The rows whose two signatures match and whose sizes allow the threshold, and their matches."""
    a, b = (np.frombuffer(b"".join(part.column(part.schema.get_field_index(c)).to_pylist()), np.uint8).reshape(-1, COORDS) for c in names)
    x, y = (np.asarray(part.column(part.schema.get_field_index(c))) for c in sizes)
    m = matches(a, b)
    ok = (m >= least) & (100 * np.minimum(x, y) >= threshold * np.maximum(x, y))
    return part.filter(pa.array(ok)), m[ok]


def _confirm(pairs: DataFrame, texts: DataFrame, k: int, threshold: int) -> DataFrame:
    """Of pairs (a, b), those with 100 * intersection >= threshold * union on the full sets.  Texts are joined by sorting whatever
    the sizes, as everywhere here, so that the same is moved a document at any scale."""
    parts = parts_of(pairs.sparkSession)
    crowd = pairs.groupBy("b").agg(F.count("*").alias("company"))
    pairs = pairs.join(crowd, "b").withColumn("salt", F.pmod(F.xxhash64("a"), F.floor((F.col("company") - 1) / HUB_SALTS) + 1))
    members = pairs.join(texts.hint("merge"), pairs["a"] == texts["cid"]).select("b", "salt", "a", "t")
    hubs = pairs.select("b", "salt").distinct().join(texts.hint("merge"), F.col("b") == texts["cid"]).select("b", "salt", F.lit(None).cast("long").alias("a"), "t")

    def run(batches):
        hub = None
        for batch in batches:
            for part in slices(batch):
                out = []
                for b, a, t in zip(*(part.column(c).to_pylist() for c in (0, 2, 3))):
                    own = shingle_set(t, k)
                    if a is None:
                        hub = own
                        continue
                    both = len(np.intersect1d(own, hub, assume_unique=True))
                    if 100 * both >= threshold * (len(own) + len(hub) - both):
                        out.append((a, b))
                yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], pa.int64()) for c in (0, 1)], names=["a", "b"])

    # a hub comes before its members in its task: a null sorts first
    both = members.unionByName(hubs).repartition(parts, "b", "salt").sortWithinPartitions("b", "salt", F.col("a").asc_nulls_first())
    return both.mapInArrow(run, "a long, b long")


def merge_labels(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels (node, label) after joining what the edges (a, b) link; each label is its component's smallest node.

    Labels hook onto smaller ones and chains of hooks are shortened until nothing moves; every step is written down, and
    dropped once the next one is.  The table that `labels` is read from stays."""
    first = labels
    while True:
        of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
        apart = edges.join(of("a"), "a").join(of("b"), "b").filter("la != lb")
        apart = stage_table(apart.select("a", "b", F.greatest("la", "lb").alias("high"), F.least("la", "lb").alias("low")), "edges")
        if hasattr(edges, "staged_path"):
            drop_table(edges)
        if apart.isEmpty():
            drop_table(apart)
            return labels
        hooks = stage_table(apart.groupBy("high").agg(F.min("low").alias("low")), "hooks")
        while True:
            onward = hooks.select(F.col("high").alias("low"), F.col("low").alias("lower"))
            jumped = stage_table(hooks.join(onward, "low", "left").select("high", F.coalesce("lower", "low").alias("low"), F.col("lower").isNotNull().alias("moved")), "hooks")
            drop_table(hooks)
            hooks = jumped
            if jumped.filter("moved").isEmpty():
                break
        merged = labels.join(hooks.select("high", "low"), labels["label"] == hooks["high"], "left").select("node", F.coalesce("low", "label").alias("label"))
        merged = stage_table(merged, "labels")
        drop_table(hooks)
        if labels is not first:
            drop_table(labels)
        labels, path = merged, apart.staged_path
        edges = apart.select("a", "b")
        edges.staged_path = path


class _Chunk:
    """The members of a list's chunk, by set size: (n, cid, label, signature) of each."""

    def __init__(self, members: list[tuple]):
        self.sig = np.frombuffer(b"".join(r[3] for r in members), np.uint8).reshape(-1, COORDS)
        self.n, self.cid, self.label = (np.array([r[c] for r in members]) for c in range(3))
        self.met = np.zeros(len(members), bool)

    def meets(self, n: int, label: int, sig: bytes, threshold: int, least: int) -> bool:
        """Whether a probe matches members of other components, which are marked; what can't reach the threshold by its size
        is skipped."""
        i, j = np.searchsorted(self.n, -(-threshold * n // 100)), np.searchsorted(self.n, 100 * n // threshold, side="right")
        near = (matches(self.sig[i:j], np.frombuffer(sig, np.uint8)) >= least) & (self.label[i:j] != label)
        self.met[i:j] |= near
        return bool(near.any())


def _involved(threshold: int, least: int):
    """(list, member) of the members and probes of each (list, chunk) that match something in another component: members come
    first, then the probes one by one."""

    def run(batches):
        group, members, held, done = None, [], None, []

        def close():
            return [] if held is None else [(group[0], c) for c in held.cid[held.met].tolist()]

        def batch_of(found):
            return pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in range(2)], names=["list", "cid"])

        for batch in batches:
            for part in slices(batch, 1024):
                for lst, chunk, probe, *row in zip(*(c.to_pylist() for c in part.columns)):
                    if (lst, chunk) != group:
                        done += close()
                        group, members, held = (lst, chunk), [], None
                    if not probe:
                        members.append(row)
                        continue
                    if held is None and members:
                        held = _Chunk(members)
                    if held is not None and held.meets(row[0], row[2], row[3], threshold, least):
                        done.append((lst, row[1]))
                if len(done) > 20_000:
                    yield batch_of(done)
                    done = []
        yield batch_of(done + close())

    return run


class _Sets:
    """Members' shingle sets, against which intersections of other sets are counted all at once."""

    def __init__(self, cids: list[int], labels: list[int], sets: list[np.ndarray]):
        self.cids, self.labels, self.sizes = cids, np.array(labels), np.array([len(s) for s in sets])
        self.known, self.places = np.unique(np.concatenate(sets), return_inverse=True)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.held = np.zeros(len(self.known), np.int64)
        self.joined: dict[int, int] = {}

    def links(self, cid: int, label: int, own: np.ndarray, threshold: int) -> list[tuple[int, int]]:
        """Links that join the component of the set `own` with others; afterwards they are one here."""
        at = np.minimum(np.searchsorted(self.known, own), len(self.known) - 1)
        at = at[self.known[at] == own]
        self.held[at] = 1
        both = np.add.reduceat(self.held[self.places], self.starts)
        self.held[at] = 0
        label = self.now(label)
        out = []
        for i in np.flatnonzero((100 * both >= threshold * (self.sizes + len(own) - both)) & (self.labels != label)).tolist():
            if self.labels[i] != label:
                out.append((cid, self.cids[i]))
                self.joined[int(self.labels[i])] = label
                self.labels[self.labels == self.labels[i]] = label
        return out

    def now(self, label: int) -> int:
        while label in self.joined:
            label = self.joined[label]
        return label


def _linked(threshold: int):
    """Links among the members and probes of each (group, chunk): members come first, then the probes one by one."""

    def run(batches):
        group, members, held, done = None, [], None, []

        def batch_of(found):
            return pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in range(2)], names=["a", "b"])

        for batch in batches:
            for part in slices(batch):
                for g, chunk, probe, cid, label, raw in zip(*(c.to_pylist() for c in part.columns)):
                    if (g, chunk) != group:
                        group, members, held = (g, chunk), [], None
                    own = np.frombuffer(raw, np.uint64)
                    if not probe:
                        members.append((cid, label, own))
                        continue
                    if held is None and members:
                        held = _Sets(*map(list, zip(*members)))
                    if held is not None:
                        done += held.links(cid, label, own, threshold)
                if len(done) > 20_000:
                    yield batch_of(done)
                    done = []
        yield batch_of(done)

    return run


def _with_sets(k: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                made = [shingle_set(t, k).tobytes() for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array([len(m) // 8 for m in made], pa.int64()), pa.array(made, pa.binary())], names=["g", "cid", "n", "shingles"])

    return run


def near_components(df: DataFrame, k: int = 5, threshold: int = 80, key: str = "doc_id", text: str = "text", exact: bool = False) -> DataFrame:
    """key, n_shingles, component_id (the smallest key reachable by links of similarity threshold / 100 or more) and kept
    (whether that is the row's own), for every row; text_hash tells rows with one key apart.

    exact: shingles are posted instead of signature pairs, so that no link is missed, at the cost of more rows.
    Null and wordless texts have no shingles and link with nothing; a null key counts as smaller than all others and gives a
    null component_id; rows that share a key are documents of their own.  An empty table gives an empty result; other
    columns are not looked at."""
    docs = _keyed(df, key, text)
    parts, least = parts_of(df.sparkSession), 0 if exact else least_matches(threshold)
    signed = stage_table(_signed(docs, k), "signatures")
    same = ["n", "f1", "f2"]
    classes = signed.filter("n > 0").groupBy(*same).agg(F.min(F.struct("k", "th")).alias("rep"), F.count("*").alias("copies"), F.first("mins").alias("mins"), F.first("sig").alias("sig"))
    classes = stage_table(classes.select(F.monotonically_increasing_id().alias("cid"), *same, F.col("rep.k").alias("a"), F.col("rep.th").alias("ah"), "copies", "mins", "sig"), "classes")
    # by sorting whatever the sizes, so that the same is moved a document at any scale; grouped where the join has put them
    read = lambda some, docs=docs: docs.join(some.select(F.col("cid"), F.col("a").alias("k"), F.col("ah").alias("th")).hint("merge"), ["k", "th"]).groupBy("k", "th", "cid").agg(F.first("t").alias("t")).select("cid", "t")
    if exact:
        size = F.col("n")
        prefixes = _prefixes(classes, _shingle_pairs(classes, read(classes), k), size, size - F.ceil(size * threshold / 100) + 1)
    else:
        prefixes = _prefixes(classes, _signature_pairs(classes), F.lit(COORDS), F.lit(COORDS - least + 1))
    posted, lists = _postings(prefixes, threshold)
    posted = posted.join(classes.select("cid", "sig"), "cid")
    posted = stage_table(posted.select("list", "company", "cid", "n", "sig"), "postings")
    drop_table(lists)
    drop_table(prefixes)
    company = stage_table(posted.select("cid").distinct(), "company")
    met = stage_table(classes.join(company, "cid", "left_semi").select("cid", "a", "ah"), "company-keys")
    texts = stage_table(read(met, _marked(docs, F.xxhash64("k", "th"), met, F.xxhash64("a", "ah"), "left_semi")), "company-texts")
    drop_table(met)
    labels = stage_table(company.select(F.col("cid").alias("node"), F.col("cid").alias("label")), "labels")
    drop_table(company)

    def similar(batches):
        for batch in batches:
            for part in slices(batch, 4096):
                found, m = _similar(part, ("sig", "sig2"), ("n", "n2"), threshold, least)
                yield pa.RecordBatch.from_arrays([found.column(0), found.column(1), pa.array(m, pa.int64())], names=["a", "b", "m"])

    top = F.max(F.struct(F.col("company"), (-F.col("cid")).alias("m"), F.struct("cid", "n", "sig").alias("row"))).alias("hub")
    hubs = posted.groupBy("list").agg(top).select("list", F.col("hub.row.cid").alias("b"), F.col("hub.row.n").alias("n2"), F.col("hub.row.sig").alias("sig2"))
    hubs = stage_table(hubs, "hubs")
    stars = posted.join(hubs, "list").filter("cid != b").select(F.col("cid").alias("a"), "b", "n", "sig", "n2", "sig2").mapInArrow(similar, "a long, b long, m long")
    best = stars.groupBy("a").agg(F.max(F.struct("m", "b")).getField("b").alias("b"))
    pairs = stage_table(best, "pairs")
    links = stage_table(_confirm(pairs, texts, k, threshold), "links")
    drop_table(pairs)
    starred = merge_labels(labels, links)

    def dealt(rest: DataFrame, group: str, chunks, *more: str) -> DataFrame:
        """Every row in one chunk of its group as a member, and in all chunks as a probe if it is outside the main component."""
        targets = rest.select("*", F.lit(False).alias("probe"), F.pmod(F.xxhash64("cid"), chunks).cast("int").alias("chunk"))
        probes = rest.filter("label != main").select("*", F.lit(True).alias("probe"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"))
        both = targets.unionByName(probes).select(group, "chunk", "probe", *more)
        return both.repartition(parts, group, "chunk").sortWithinPartitions(group, "chunk", "probe", *more[:2])

    # lists that still hold several components: their rows with labels, the list's length and its hub's label
    rest = posted.join(starred, posted["cid"] == starred["node"]).drop("node", "company")
    state = rest.groupBy("list").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("members")).filter("x != y")
    state = stage_table(state.join(hubs.join(starred, hubs["b"] == starred["node"]).select("list", F.col("label").alias("main")), "list").select("list", "members", "main"), "open-lists")
    chunks = (F.floor((F.col("members") - 1) / CHUNK) + 1).cast("int")
    met = dealt(rest.join(state, "list"), "list", chunks, "n", "cid", "label", "sig").mapInArrow(_involved(threshold, least), "list long, cid long")
    involved = stage_table(met.distinct(), "involved")
    for used in (state, hubs, posted):
        drop_table(used)
    final = starred
    if not involved.isEmpty():
        nodes = stage_table(involved.select(F.col("cid").alias("node"), F.col("cid").alias("label")).distinct(), "nodes")
        edges = involved.join(involved.groupBy("list").agg(F.min("cid").alias("b")), "list").filter("cid != b").select(F.col("cid").alias("a"), "b").distinct()
        groups = merge_labels(nodes, stage_table(edges, "meetings"))
        sets = groups.select(F.col("label").alias("g"), F.col("node").alias("cid")).join(texts.hint("merge"), "cid").select("g", "cid", "t").mapInArrow(_with_sets(k), "g long, cid long, n long, shingles binary")
        sets = stage_table(sets.join(starred, sets["cid"] == starred["node"]).drop("node"), "sets")
        by_label = sets.groupBy("g", "label").agg(F.sum("n").alias("n"))
        state = stage_table(by_label.groupBy("g").agg(F.sum("n").alias("total"), F.max(F.struct("n", "label")).getField("label").alias("main")), "groups")
        chunks = (F.floor(F.col("total") / CHUNK_SHINGLES) + 1).cast("int")
        found = dealt(sets.join(state, "g"), "g", chunks, "cid", "label", "shingles").mapInArrow(_linked(threshold), "a long, b long")
        links = stage_table(found, "links")
        for used in (sets, state, groups):
            drop_table(used)
        if groups.staged_path != nodes.staged_path:
            drop_table(nodes)
        final = merge_labels(starred, links)
    drop_table(texts)
    drop_table(involved)
    for used in (starred, labels):
        if used.staged_path != final.staged_path:
            drop_table(used)

    named = classes.join(final, classes["cid"] == final["node"], "left").withColumn("label", F.coalesce("label", "cid"))
    least_key = named.groupBy("label").agg(F.min("a").alias("component"))
    named = named.join(least_key, "label").select(*(F.col(c).alias(f"{c}_") for c in same), "component", "copies")
    named = stage_table(named, "components")
    for used in (classes, final):
        drop_table(used)
    return _named_rows(signed, named, same, key)


def _named_rows(signed: DataFrame, named: DataFrame, same: list[str], key: str) -> DataFrame:
    """signed's rows with their classes' components.  Classes of many copies are few and come by a broadcast; empty sets need none."""
    own = signed.select("k", "th", *same)
    filled, total = own.filter("n > 0"), signed.count()
    often = F.broadcast(named.filter(F.col("copies") > total / HEAVY).drop("copies"))
    rest = named.filter(F.col("copies") <= total / HEAVY).drop("copies")
    on = lambda other: (F.col("n") == other["n_"]) & (F.col("f1") == other["f1_"]) & (F.col("f2") == other["f2_"])
    kept = ["k", "th", "n", "component"]
    out = filled.join(often, on(often)).select(*kept).unionByName(filled.join(often, on(often), "left_anti").join(rest, on(rest)).select(*kept))
    out = out.unionByName(own.filter("n = 0").select("k", "th", "n", F.col("k").alias("component")))
    null = lambda c: F.when(F.col(c) != FIRST, F.col(c))
    return out.select(null("k").alias(key), F.col("n").alias("n_shingles"), null("component").alias("component_id"), (F.col("k") == F.col("component")).alias("kept"), F.col("th").alias("text_hash"))


def keep_representatives(df: DataFrame, k: int = 5, threshold: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df's rows, one of each component, with all their columns; what links with nothing stays.

    Null and wordless texts stay; a null key is smaller than all others; of a component, all rows that have its smallest key and
    the text of one of them stay, so repeated rows stay together; an empty table gives an empty one."""
    found = near_components(df.select(key, text), k, threshold, key, text)
    found = stage_table(found.select(F.col(key).alias("_rw_key"), F.col("text_hash").alias("_rw_hash"), "kept").distinct(), "found")
    # most rows certainly aren't among those that go, and stay where they are
    own, gone = (F.xxhash64(df[key].cast("long"), F.xxhash64(df[text])), found.filter(~F.col("kept"))), F.xxhash64("_rw_key", "_rw_hash")
    stays, rest = (_marked(df, *own, gone, how) for how in ("left_anti", "left_semi"))
    found = found.filter("kept")
    return stays.union(rest.join(found, rest[key].eqNullSafe(found["_rw_key"]) & (F.xxhash64(rest[text]) == F.col("_rw_hash")), "left_semi"))


def op7_minhash(spark, sf_dir):
    """Components of documents whose sets of two-word shingles are similar by 0.8 or more; for odd rows see near_components()."""
    return near_components(documents(spark, sf_dir), k=2, threshold=80).drop("text_hash")


SQL = {
    "op7_minhash": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, x FROM (
  SELECT doc_id, w[i] || ' ' || w[i + 1] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d WHERE len(w) >= 2)
  UNION ALL SELECT doc_id, w[1] FROM d WHERE len(w) = 1)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(min(r.c), d.doc_id) AS component_id, coalesce(min(r.c), d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id, n"""
}
