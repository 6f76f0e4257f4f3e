"""Each operator against a brute-force version on a small table, on odd rows and on an empty table."""

import hashlib
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import pytest
from tokenizers import Tokenizer

from runweave.llm import bpe_automaton, exact_dedup, langid, lm, media, minhash, packing, sharding, substring_dedup, token_files, token_ids
from runweave.llm.common import lower_words, words

PATH = token_ids.vocabulary_path()


@pytest.fixture(scope="session")
def tool():
    return Tokenizer.from_file(PATH)


def rows(df):
    return [r.asDict() for r in df.collect()]


def ascii_lower(text):
    return (text or "").encode().lower().decode()


# --- 1: sharding ---


def test_ring_by_hand():
    points = [(10, 0), (20, 1), (30, 0), (40, 2)]
    plan = sharding.walk_ring(points, {0: 5, 1: 1, 2: 0, 3: 0}, 3, 1.0)
    assert plan == [(0, 0, 2, 0, 0), (1, 0, 1, 1, 0), (0, 2, 3, 1, 1), (0, 3, 5, 2, 0)]
    assert sharding.walk_ring(points, {0: 5, 1: 1}, 3, None) == [(0, 0, 5, 0, 0), (1, 0, 1, 1, 0)]
    assert sorted(x for s, lo, hi, _ in sharding.arc_slices(sharding.ring_points(5, 8)) for x in (hi - lo,)) and sum(hi - lo + 1 for _, lo, hi, _ in sharding.arc_slices(sharding.ring_points(5, 8))) == 1 << 63


@pytest.mark.parametrize("table", ["docs", "odd", "empty"])
def test_shards(request, table):
    df = request.getfixturevalue(table)
    want = sorted((str(r["doc_id"]), len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in rows(df.select("doc_id", "text")))
    for factor in (1.0, 1.5, None):
        out = rows(sharding.assign_shards(df, 7, load_factor=factor))
        assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in out) == want
        slots = defaultdict(list)
        for r in out:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        counts = [len(slots[s]) for s in range(7)]
        if factor == 1.0:
            assert max(counts) - min(counts) <= 1
        elif factor:
            assert max(counts) <= -(-1.5 * len(out) // 7)


def test_plain_ring_moves_rows_only_into_the_new_shard(docs):
    a = {r["doc_id"]: r["shard"] for r in rows(sharding.assign_shards(docs, 9, load_factor=None))}
    b = {r["doc_id"]: r["shard"] for r in rows(sharding.assign_shards(docs, 10, load_factor=None))}
    moved = [k for k in a if a[k] != b[k]]
    assert moved and all(b[k] == 9 for k in moved) and len(moved) < len(a) / 4
    c = {r["doc_id"]: r["shard"] for r in rows(sharding.assign_shards(docs, 9, load_factor=1.25))}
    assert sum(a[k] == c[k] for k in a) > 0.6 * len(a)  # most keys stay at home


# --- 2: token files ---


def test_packing_of_values():
    rng = np.random.default_rng(0)
    for _ in range(60):
        docs_ = [rng.integers(0, [200, 70_000, 1 << 32][rng.integers(3)], rng.integers(0, 9), dtype=np.uint64).astype(np.uint32) for _ in range(rng.integers(1, 6))]
        both = [token_files.pack(d) for d in docs_]
        control, data = (np.frombuffer(b"".join(b[k] for b in both), np.uint8) for k in (0, 1))
        assert (token_files.unpack(control, data, np.array([len(d) for d in docs_])) == np.concatenate(docs_)).all()


@pytest.mark.parametrize("table", ["docs", "odd", "empty"])
def test_token_files(request, tool, table):
    df = request.getfixturevalue(table)
    files = token_files.write_token_files(df, PATH, 0)
    out = sorted(rows(files.digest()), key=lambda r: r["start"])
    at, keys = 0, []
    texts = defaultdict(list)
    for r in rows(df.select("doc_id", "text")):
        ids = [*tool.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        texts[r["doc_id"]].append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for r in out:
        assert r["start"] == at
        at += r["n_tokens"]
        keys.append(r["doc_id"])
        texts[r["doc_id"]].remove((r["n_tokens"], r["ids_crc32"]))
    assert not any(texts.values())
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    assert len(files.by_rank) >= 50_257 and sorted(files.by_rank.tolist()) == list(range(len(files.by_rank)))


def test_files_in_the_order_of_names_hold_ascending_keys(docs):
    import glob

    import pyarrow.parquet as pq

    files = token_files.write_token_files(docs.repartition(7), PATH, 0)
    keys, at = [], 0
    for name in sorted(glob.glob(f"{files.blocks.staged_path}/part-*")):
        for raw in pq.read_table(name)["block"].to_pylist():
            own, counts, ids, _ = token_files.read_block(raw, files.by_rank)
            keys, at = keys + own, at + int(counts.sum())
    assert keys == sorted(keys) and len(keys) == docs.count() and at == sum(r["n_tokens"] for r in rows(files.digest()))


def test_ids_of_many_texts_at_once(tool):
    import pyarrow as pa

    texts = [None, "", " ", "a", "  a b", "x\ny z", "a\n b", "<|endoftext|> hi<|endoftext|>", "é à\xa0b c", "tab\t x", "a  ", " a", "a ", "漢字 🙂 ok.", "one two, two. Two two"] * 3
    for encoder in (token_ids.IdEncoder(PATH, seen=3), bpe_automaton.AutomatonEncoder(PATH, seen=3)):
        for end in (None, 7):
            ids, sizes = encoder.encode_many(pa.array(texts), end)
            at = 0
            for t, n in zip(texts, sizes.tolist()):
                assert ids[at : at + n].tolist() == tool.encode(t or "", add_special_tokens=False).ids + ([] if end is None else [end])
                at += n
            assert at == len(ids)
        assert [len(x) for x in encoder.encode_many(pa.array([], pa.string()), 7)] == [0, 0]


def test_ids_of_odd_texts(tool):
    import random

    rng, fast = random.Random(3), token_ids.IdEncoder(PATH, seen=50)
    exact = bpe_automaton.AutomatonEncoder(PATH, seen=50)
    letters = [*"ab Z9'.,!?\n\t \r  \x0b\x1c\x85\xa0 　éß½²ªº漢字🙂́\x00", "'s", "'ll", " the", " of", "<|endoftext|>", "\n\n", "  "]
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 14)))
        want = tool.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(fast.encode(text), fast.dtype).tolist() == want, text
        assert exact.ids(text) == want and exact.decode(want) == tool.decode(want, skip_special_tokens=False), text
    for _ in range(3000):
        text = "".join(rng.choice(rng.choice(["a", "aA", "abc", "-", "=-", "\n ", " .", "etaoinshr", "é漢"])) for _ in range(rng.randint(1, 40)))
        assert exact.ids(text) == tool.encode(text, add_special_tokens=False).ids, text


# --- 3: packing ---


def test_mixture_serves_in_order():
    from fractions import Fraction

    rng = np.random.default_rng(4)
    for _ in range(60):
        n = int(rng.integers(1, 6))
        held = [int(v) for v in rng.integers(1, 60, n)]
        weights = held if rng.random() < 0.5 else [int(v) for v in rng.integers(1, 9, n)]
        length = int(rng.integers(1, 20))
        mix = packing.Mixture(held, weights, length)
        order = sorted((Fraction(2 * x + 1, weights[s]), s) for s in range(n) for x in range(held[s]))
        want = defaultdict(list)
        for g, (_, s) in enumerate(order):
            want[g // length].append(s)
        cells = {}
        for s in range(n):
            at = 0
            while at < held[s]:
                size = min(int(rng.integers(1, 9)), held[s] - at)
                for _, some, w, place in mix.pieces(s, at, size):
                    for k in range(some):
                        assert (w, place + k) not in cells
                        cells[w, place + k] = s
                at += size
        for w, sources in want.items():
            assert sorted(sources) == [cells[w, k] for k in range(len(sources))]


def test_deficits_are_carried():
    """Window by window: a quantum comes in, whole tokens go out, and the rest is the next window's deficit."""
    rng = np.random.default_rng(5)
    for _ in range(40):
        n, length = int(rng.integers(1, 6)), int(rng.integers(1, 30))
        held = [int(v) for v in rng.integers(1, 200, n)]
        weights = [int(v) for v in rng.integers(1, 9, n)]
        mix = packing.Mixture(held, weights, length)
        deficit, left = [0] * n, list(held)
        for w in range(sum(held) // length):
            assert deficit == mix.deficits(w)
            before, place = mix.window(w)
            gives = [place[s + 1] - place[s] for s in range(n)]
            assert sum(gives) == length and sum(mix.quanta(w)) == length
            assert before == [h - x for h, x in zip(held, left)]
            left = [x - g for x, g in zip(left, gives)]
            deficit = [d + q - g for d, q, g in zip(deficit, mix.quanta(w), gives)]
            assert min(left) >= 0 and all(abs(d) <= n for d in deficit)
            alive = [s for s in range(n) if left[s]]
            if len(alive) == n:  # nobody has run dry: proportions are the targets' to within a token
                assert all(abs((held[s] - left[s]) - (w + 1) * length * weights[s] / sum(weights)) <= 1 for s in range(n))


@pytest.mark.parametrize("table", ["docs", "odd", "empty"])
@pytest.mark.parametrize("weights", [None, {"src0": 5, "src1": 1, "s": 3}])
def test_pack_documents(request, tool, table, weights):
    df = request.getfixturevalue(table)
    out = rows(packing.pack_documents(df, PATH, 1, length=256, weights=weights))
    want = Counter()
    for r in rows(df.select("doc_id", "text")):
        ids = [*tool.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        want[r["doc_id"], len(ids)] += len(ids)
    have = Counter()
    for r in out:
        have[r["doc_id"], r["doc_tokens"]] += r["length"]
    assert have == want
    windows = defaultdict(list)
    for r in out:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    total = sum(want.values())
    assert sorted(windows) == list(range(-(-total // 256)))
    for w, pieces in windows.items():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 256 or w == total // 256
    if table == "docs" and weights is None:
        share = Counter()
        for r in out:
            share[r["source"]] += r["length"]
        for w in list(windows)[:-1]:
            here = Counter()
            for r in out:
                if r["sequence_id"] == w:
                    here[r["source"]] += r["length"]
            assert all(abs(here[s] - 256 * n / total) < 2 + len(share) * n / total for s, n in share.items())
        ids = {r["doc_id"]: [*tool.encode(r["text"], add_special_tokens=False).ids, 1] for r in rows(df)}
        assert all(zlib.crc32(np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] for r in out)


# --- 4: BPE ---


@pytest.mark.parametrize("table", ["docs", "odd", "empty"])
def test_bpe(request, tool, table):
    df = request.getfixturevalue(table)
    want = []
    for r in rows(df.select("doc_id", "text")):
        ids = tool.encode(r["text"] or "", add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((str(r["doc_id"]), len(ids), sha(",".join(map(str, ids))), sha(tool.decode(ids, skip_special_tokens=False))))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows(bpe_automaton.round_trip(df, PATH))) == sorted(want)
    back = bpe_automaton.decode_ids(bpe_automaton.encode_texts(df, PATH), PATH)
    assert Counter((r["doc_id"], r["text"]) for r in rows(back)) == Counter((r["doc_id"], r["text"] or "") for r in rows(df.select("doc_id", "text")))


def test_small_automaton():
    vocab = {t: i for i, t in enumerate(["a", "b", "c", "ab", "bc", "abc", "aa", "aaaa"])}
    merges = [("a", "b"), ("b", "c"), ("ab", "c"), ("a", "a"), ("aa", "aa")]

    def by_rank(letters):
        parts, rank = list(letters), {m: k for k, m in enumerate(merges)}
        while True:
            best = min((rank.get((p, q), 99) for p, q in zip(parts, parts[1:])), default=99)
            if best == 99:
                return [vocab[p] for p in parts]
            out, i = [], 0
            while i < len(parts):
                if rank.get(tuple(parts[i : i + 2])) == best:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out

    machine = bpe_automaton.Automaton(vocab, merges)
    from itertools import product

    for n in range(1, 9):
        for word in map("".join, product("abc", repeat=n)):
            assert machine.encode(word) == by_rank(word), word


# --- 5: substring ---


def brute_repeats(table, window):
    first = {}
    for k, text in table:
        w = words(text)
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            first[g] = min(first.get(g, k), k)
    for k, text in table:
        w, gone = words(text), set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < k:
                gone.update(range(i, i + window))
        yield len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()


@pytest.mark.parametrize("table", ["docs", "odd", "empty"])
@pytest.mark.parametrize(("window", "hot"), [(13, 20_000), (13, 1), (4, 20_000), (50, 20_000)])
def test_repeats(request, table, window, hot):
    df = request.getfixturevalue(table)
    texts = [(r["doc_id"] if r["doc_id"] is not None else substring_dedup.FIRST, r["text"]) for r in rows(df.select("doc_id", "text"))]
    out = rows(substring_dedup.repeat_digest(df, window, hot=hot))
    assert sorted((r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out) == sorted(brute_repeats(texts, window))
    if (window, hot) == (13, 20_000):
        stripped = substring_dedup.strip_repeats(df, window)
        assert stripped.columns == df.columns and stripped.count() == df.count()
        shas = Counter(hashlib.sha256(b" ".join(words(r["text"]))).hexdigest() for r in rows(stripped))
        assert shas == Counter(r["kept_sha256"] for r in out)


def test_suffix_automaton():
    import random

    rng = random.Random(2)
    for _ in range(200):
        machine, held = substring_dedup.SuffixAutomaton(), []
        for _ in range(rng.randint(1, 4)):
            held.append([rng.choice("ab") for _ in range(rng.randint(0, 12))])
            machine.add(held[-1])
        query = [rng.choice("abc") for _ in range(15)]
        text = ["".join(h) for h in held]
        for i, size in enumerate(machine.statistics(query)):
            want = next(n for n in range(i + 1, -1, -1) if n == 0 or any("".join(query[i + 1 - n : i + 1]) in t for t in text))
            assert size == want


# --- 6: media ---


def test_codecs():
    assert media.mulaw_table()[[0, 127, 128, 255]].tolist() == [-32124, 0, 32124, 0]
    assert media.alaw_table()[[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]
    sound = (8000 * np.sin(np.arange(5000) / 9)).astype(np.int16)
    for kind in (media.MULAW, media.ALAW):
        assert np.abs(media.expand(media.compand(sound, kind), kind).astype(int) - sound).max() < 400
    coded = media.encode_ima(sound, 256)
    assert np.abs(media.decode_ima(coded, 256)[:5000].astype(int) - sound).mean() < 200
    value, index, out = int.from_bytes(coded[:2], "little", signed=True), coded[2], []
    for code in [c for b in coded[4:256] for c in (b & 15, b >> 4)]:
        step = media.IMA_STEP[index]
        delta = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
        value = max(-32768, min(32767, value - delta if code & 8 else value + delta))
        index = max(0, min(88, index + media.IMA_INDEX[code & 7]))
        out.append(value)
    assert media.decode_ima(coded, 256)[1:505].tolist() == out
    for rate, n in ((16000, 10000), (11025, 6891), (4000, 2500)):
        assert len(media.resample(sound, 8000, rate)) == n
    assert (media.resample(sound, 8000, 16000)[::2] == sound).all()
    assert media.from_wav(media.to_wav(coded, media.IMA, 8000, 256)) == (media.IMA, 8000, 256, coded)
    assert media.from_wav(b"RIFF") is None and media.from_wav(None) is None


def ima_by_hand(codes, value=0, index=0):
    """Samples of one ADPCM block, sample by sample."""
    out = [value]
    for code in codes:
        step = media.IMA_STEP[index]
        delta = step >> 3
        for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
            delta += part if code & bit else 0
        value = max(-32768, min(32767, value - delta if code & 8 else value + delta))
        index = max(0, min(88, index + media.IMA_INDEX[code & 7]))
        out.append(value)
    return out


def pcm_by_hand(payload):
    kind = media.KINDS[zlib.crc32(payload) % 3]
    if kind != media.IMA:
        table = media.mulaw_table() if kind == media.MULAW else media.alaw_table()
        return np.array([table[b] for b in payload], np.int16)
    return np.array([x for at in range(0, len(payload), 64) for x in ima_by_hand([c for b in payload[at : at + 64] for c in (b & 15, b >> 4)])], np.int16)


@pytest.mark.parametrize("table", ["docs", "odd", "empty"])
def test_media(request, table):
    df = request.getfixturevalue(table)
    stored = media.store_text_media(df)
    want, kinds = [], set()
    for r in rows(df.select("doc_id", "text")):
        raw = (r["text"] or "").encode()
        full = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        wav = media.from_payload(full)
        kinds.add(media.from_wav(wav)[0])
        pcm = media.resample(pcm_by_hand(full), media.RATE, media.STORED_RATE)
        want.append((str(r["doc_id"]), len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]), len(wav), hashlib.sha256(wav).hexdigest(), media.features(pcm)))
    out = rows(media.media_digest(stored))
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_bytes"], r["media_sha256"], r["feature"]) for r in out) == sorted(want)
    assert not want or kinds == set(media.KINDS)
    pcm = rows(media.decode_media(stored, to_rate=16000).selectExpr("n_samples", "length(pcm) AS size"))
    assert all(r["size"] == 2 * r["n_samples"] for r in pcm)


def test_features_by_hand():
    pcm = np.array([3, -4, 0, 5], np.int16)
    assert media.features(pcm) == f"4|12|5|2|{zlib.crc32(pcm.tobytes()):08x}" and media.features(pcm[:0]) == "0|0|0|0|00000000"


def test_broken_media(spark):
    good = media.from_payload(b"a" * 64)
    cut = media.to_wav(bytes(68) + bytes(10), media.IMA, block=68)
    bad = [None, b"", b"RIFF", good[:30], b"RIFF" + bytes(60), good.replace(good[20:22], b"c\x00", 1), media.to_wav(b"abc", media.MULAW, rate=0), media.to_wav(b"", media.IMA, block=4)]
    df = spark.createDataFrame([(i, 1, bytearray(x) if x is not None else None, "p", 3) for i, x in enumerate([*bad, good, cut])], "doc_id long, n_bytes long, media binary, pcm string, peak int")
    out = {r["doc_id"]: r for r in rows(media.media_digest(df))}
    assert all(out[i]["payload_sha256"] is None and out[i]["feature"] is None for i in range(len(bad))) and out[0]["media_bytes"] is None and out[1]["media_bytes"] == 0
    assert out[8]["payload_bytes"] == 64 and out[8]["feature"] and out[9]["payload_bytes"] == 70
    decoded = {r["doc_id"]: r for r in rows(media.decode_media(df))}
    assert decoded[0]["pcm"] is None and decoded[3]["n_samples"] is None and decoded[8]["n_samples"] > 0 and set(decoded[8]) == {"doc_id", "n_bytes", "media", "pcm", "n_samples", "peak"}


# --- 7: near duplicates ---


def brute_components(table, k, threshold):
    sets = []
    for _, text in table:
        w = lower_words(text)
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    parent = list(range(len(table)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(table)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = defaultdict(lambda: 1 << 62)
    for i, (key, _) in enumerate(table):
        least[find(i)] = min(least[find(i)], key)
    return [(key, len(sets[i]), least[find(i)]) for i, (key, _) in enumerate(table)]


@pytest.mark.parametrize("table", ["docs", "odd", "empty"])
@pytest.mark.parametrize("k", [2, 5])
def test_near_components(request, table, k):
    df = request.getfixturevalue(table)
    texts = [(r["doc_id"] if r["doc_id"] is not None else minhash.FIRST, r["text"]) for r in rows(df.select("doc_id", "text"))]
    out = [(r["doc_id"] if r["doc_id"] is not None else minhash.FIRST, r["n_shingles"], r["component_id"] if r["component_id"] is not None else minhash.FIRST) for r in rows(minhash.near_components(df, k))]
    assert sorted(out) == sorted(brute_components(texts, k, 80))


def chain():
    """Texts of which each is near the next one only, so that hubs alone don't connect them."""
    base = [f"w{i}" for i in range(400)]
    return [" ".join(base[12 * j : 12 * j + 130]) for j in range(20)]


@pytest.mark.parametrize("exact", [False, True])
def test_chain_of_near_copies(spark, monkeypatch, exact):
    """In small chunks, so that a group's members are dealt over many tasks."""
    monkeypatch.setattr(minhash, "CHUNK", 3)
    monkeypatch.setattr(minhash, "CHUNK_SHINGLES", 300)
    monkeypatch.setattr(minhash, "HUB_SALTS", 2)
    texts = chain()
    df = spark.createDataFrame([(j, t) for j, t in enumerate(texts)], "doc_id long, text string")
    out = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows(minhash.near_components(df, 2, exact=exact)))
    assert out == sorted(brute_components(list(enumerate(texts)), 2, 80)) and {c for _, _, c in out} == {0}


def test_near_components_exact(docs):
    assert rows(minhash.near_components(docs, 5, exact=True).orderBy("doc_id")) == rows(minhash.near_components(docs, 5).orderBy("doc_id"))


def staged_rows(monkeypatch):
    """Rows of the tables that minhash stages from now on, by name."""
    found, stage = {}, minhash.stage_table

    def counted(df, name):
        out = stage(df, name)
        found[name] = out.count()
        return out

    monkeypatch.setattr(minhash, "stage_table", counted)
    return found


def test_lists_hold_what_sizes_allow(spark, monkeypatch):
    # documents that begin alike, each nearly twice as long as the one before; one has a near copy
    text = lambda i: " ".join(f"w{x}" for x in range(int(6 * 1.9**i)))
    df = spark.createDataFrame([*((i, text(i)) for i in range(8)), (50, text(5) + " more")], "doc_id long, text string")
    found = staged_rows(monkeypatch)
    out = sorted((r["doc_id"], r["component_id"]) for r in rows(minhash.near_components(df, 2)))
    assert out == [*((i, i) for i in range(8)), (50, 5)]
    assert found["company-texts"] == 2 and found["postings"] <= 2 * minhash.COORDS


@pytest.mark.parametrize("threshold", [50, 80, 95, 100])
def test_sizes_that_may_link_share_lists(spark, threshold):
    sizes = [(n, n, 1, [7]) for n in range(1, 400)]
    pairs = {(a, b) for a, *_ in sizes for b in range(a, min(399, 100 * a // threshold) + 1) if a != b}
    for a, b in sorted(pairs)[:: max(1, len(pairs) // 8)]:
        df = spark.createDataFrame([(a, a, 1, [7]), (b, b, 1, [7])], "cid long, n long, company long, lists array<long>")
        assert sorted(r["cid"] for r in minhash._postings(df, threshold)[0].collect()) == [a, b]


def test_signing_forgets_encoders(tool):
    """A worker that has encoded texts and goes on to sign some doesn't keep the encoder's units beside them."""
    import pyarrow as pa

    class Docs:
        def mapInArrow(self, run, _):
            return run

    assert token_ids.encoder(PATH).encode("some text") and token_ids._ENCODERS
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array(["a b c"])], names=["k", "th", "t"])
    assert [x.num_rows for x in minhash._signed(Docs(), 2)([batch])] == [1] and not token_ids._ENCODERS
    assert token_ids.encoder(PATH).encode("some text")


def test_identification_forgets_encoders(tool):
    """Neither does one that goes on to the pipeline's first stage, after which exact_dedup leaves workers as they are."""
    import pyarrow as pa
    from pyspark.sql import types as T

    class Docs:
        schema = T.StructType([T.StructField("text", T.StringType())])

        def mapInArrow(self, run, _):
            return run

    assert token_ids.encoder(PATH).encode("some text") and token_ids._ENCODERS
    raw = {"en": b"the quick brown fox jumps over the lazy dog", "de": b"der schnelle braune Fuchs springt"}
    batch = pa.RecordBatch.from_arrays([pa.array(["the quick brown fox jumps over the lazy dog", None])], names=["text"])
    assert [x.num_rows for x in langid.keep_identified(Docs(), raw)([batch])] == [1] and not token_ids._ENCODERS


def test_encoders_remember_what_they_are_told_to(spark, tool):
    """Workers of the pipeline's packing stage take less memory for the units they have seen; ids stay those of the library."""
    import pyarrow as pa

    from corpus_pipeline import SEEN

    class Docs:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    assert SEEN < token_ids.SEEN and token_ids.encoder(PATH, SEEN).batch_bytes < token_ids.encoder(PATH).batch_bytes == token_ids.BATCH_BYTES
    texts = [" ".join(f"word{i * 40 + x}" for x in range(40)) for i in range(20)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    for seen in (100, token_ids.SEEN):
        run = token_ids.tokenise(Docs(), PATH, 1, "doc_id", "text", seen=seen)
        got = [x.as_py() for _ in range(3) for part in run([batch]) for x in part.column(3)]
        assert got == [np.array([*tool.encode(t or "", add_special_tokens=False).ids, 1], token_ids.encoder(PATH, seen).dtype).tobytes() for t in texts] * 3
        assert list(token_ids._ENCODERS) == [(PATH, seen)]
        assert bool(token_ids.encoder(PATH, seen).rest.old) == (seen == 100)


@pytest.mark.parametrize("marks", [1, 64, 1 << 19])
def test_representatives_stay_where_they_are(spark, monkeypatch, marks):
    monkeypatch.setattr(minhash, "MARKS", marks)
    text = lambda i: " ".join(f"w{i}x{x}" for x in range(40))
    data = [(i, text(i % 60), i) for i in range(90)] + [(100 + i, text(i) + " more", i) for i in range(5)] + [(None, text(70), 0), (200, None, 1), (201, "", 2)]
    df = spark.createDataFrame(data, "doc_id long, text string, k long")
    out = minhash.keep_representatives(df)
    assert sorted(str(r) for r in out.collect()) == sorted(str(r) for r in df.filter("doc_id IS NULL OR doc_id < 60 OR doc_id >= 200").collect())
    # texts that stay for certain don't move: only those of rows that may go are sorted
    assert "LeftAnti" in out._jdf.queryExecution().executedPlan().toString()


def test_many_copies_come_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(minhash, "HEAVY", 4)
    texts = ["a b c d"] * 9 + ["", None, "e f g", "e f g", "a b c d e"]
    df = spark.createDataFrame([(j, t) for j, t in enumerate(texts)], "doc_id long, text string")
    out = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows(minhash.near_components(df, 2)))
    assert out == sorted(brute_components(list(enumerate(texts)), 2, 80))


def test_keys_of_several_texts(spark):
    """Rows that share a key are documents of their own: their components meet only where their texts are near."""
    df = spark.createDataFrame([(5, "a b c d e f g"), (5, "p q r s t u v"), (7, "a b c d e f g"), (3, "p q r s t u v")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in rows(minhash.near_components(df, 2))) == [(3, 3, True), (5, 3, False), (5, 5, True), (7, 5, False)]


def test_matches_lose_few_links():
    from math import comb

    for threshold in (50, 80, 90):
        least = minhash.least_matches(threshold)
        tail = lambda m, s=threshold / 100: sum(comb(minhash.COORDS, i) * s**i * (1 - s) ** (minhash.COORDS - i) for i in range(m))
        assert tail(least) <= minhash.LOSS < tail(least + 1)


def test_intersections_with_a_group():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 300, np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(300) < keep], rng.integers(0, 1 << 63, int(300 * (1 - keep)), np.uint64)])) for keep in np.linspace(0.6, 1, 40)]
    for p, own in enumerate(sets):
        held = minhash._Sets(list(range(40)), list(range(100, 140)), sets)
        near = {i for i, s in enumerate(sets) if 100 * len(np.intersect1d(s, own)) >= 80 * len(np.union1d(s, own))}
        assert {b for _, b in held.links(p, 100 + p, own, 80)} == near - {p}
        assert held.links(p, 100 + p, own, 80) == [] and len({held.now(100 + i) for i in near}) == 1


# --- 8: exact duplicates ---


@pytest.mark.parametrize("table", ["docs", "odd", "empty"])
@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups(request, table, weak):
    df = request.getfixturevalue(table)
    hash_of = (lambda c: exact_dedup.F.pmod(exact_dedup.F.xxhash64(c), exact_dedup.F.lit(3))) if weak else exact_dedup._hash
    groups = defaultdict(list)
    for r in rows(df.select("doc_id", "text")):
        groups[ascii_lower(r["text"])].append(r["doc_id"])
    want = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(str(i), str(keep), len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    out = rows(exact_dedup.exact_groups(df, hash_of=hash_of))
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"], r["text_sha256"]) for r in out) == sorted(want)
    kept = exact_dedup.keep_first(df)
    assert kept.columns == df.columns and kept.count() == len(groups)


# --- 9: languages ---


def test_languages(docs, odd, empty):
    raw = langid.fit(docs.filter(~langid.held_out()))
    assert set(raw) == {"de", "en", "es", "fr"} and max(map(len, raw.values())) <= langid.DICT_BYTES
    lang = {r["doc_id"]: r["lang"] for r in rows(docs)}
    out = [r for r in rows(langid.identify(docs, raw)) if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in out]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in out)
    found = {r["doc_id"]: r for r in rows(langid.identify(odd, raw))}
    assert all(found[k]["lang_pred"] == "und" and found[k]["rejected"] for k in (1, 2, 3, 7)) and found[4]["lang_pred"] != "und"
    assert langid.identify(empty, raw).count() == 0
    assert {r["lang_pred"] for r in rows(langid.identify(odd, langid.fit(empty)))} == {"und"}
    assert langid.keep_identified(odd, raw).columns == odd.columns


def test_a_language_with_one_short_document(spark, docs):
    train = docs.filter(~langid.held_out()).select("lang", "text")
    few = spark.createDataFrame([("xx", " "), ("yy", "Tere hommikust, kuidas läheb?")], "lang string, text string")
    raw, plain = langid.fit(train.unionByName(few)), langid.fit(train)
    assert set(raw) == {*plain, "xx", "yy"} and {k: raw[k] for k in plain} == plain and min(map(len, plain.values())) > 10_000
    held = rows(docs.filter(langid.held_out()).select("text", "lang"))
    model, before = langid.Classifier(raw), langid.Classifier(plain)
    found, alone = ([m.classify(r["text"]) for r in held] for m in (model, before))
    assert [f[0] for f in found] == [f[0] for f in alone]
    assert [f[3] for f in found] == [f[3] for f in alone] and model.classify("tere hommikust")[0] == "yy"


def brute_language(raw, text):
    """The smallest total over blocks compressed with each dictionary, by a compressor made anew for each block."""
    import zstandard as z

    size = max(map(len, raw.values()))
    if text is None or not any(c.isalpha() for c in text):
        return "und"

    def total(data):
        filled = ((data + b"\n") * size)[:size] if data else b"\n" * size
        out = 0
        for at in range(0, len(text), 4096):
            block = text[at : at + 4096].lower()
            while len(block) < 256 and len(block) < 255 + len(text[at : at + 4096]) + 1:
                block = f"{text[at : at + 4096].lower()} " * -(-256 // (len(text[at : at + 4096].lower()) + 1))
            out += len(z.ZstdCompressor(level=langid.LEVEL, dict_data=z.ZstdCompressionDict(filled, dict_type=z.DICT_TYPE_RAWCONTENT), write_content_size=False).compress(block.encode()))
        return out

    return min((total(raw[lang]), lang) for lang in raw)[1]


def test_predictions_by_brute_force(docs):
    raw = langid.dictionaries({lang: texts[:12] for lang, texts in langid.sample_texts(docs, "lang", "text").items()}, size=1000)
    model = langid.Classifier(raw)
    texts = [r["text"] for r in docs.limit(40).collect()] + ["one", "été", None, "12", ""]
    assert [model.classify(t)[0] for t in texts] == [brute_language(raw, t) for t in texts]


def test_a_hundred_languages(spark):
    letters = "bcdfghjklm"
    rows_ = [(f"l{a}{b}", " ".join(letters[a] + "aeiou"[i % 5] + letters[b] + "uoiea"[(i + k) % 5] for i in range(60)), k) for a in range(10) for b in range(10) for k in range(3)]
    df = spark.createDataFrame(rows_, "lang string, text string, k int")
    raw = langid.fit(df.filter("k < 2"))
    model = langid.Classifier(raw)
    assert len(raw) == 100 and np.mean([model.classify(t)[0] == lang for lang, t, k in rows_ if k == 2]) > 0.95


# --- 10: language model ---


def small_ranks(size=60):
    rng = np.random.default_rng(4)
    return lm.Ranks(rng.integers(0, 50, size), np.append(rng.random(size - 1) < 0.5, True))


def test_ranks(monkeypatch):
    monkeypatch.setattr(lm, "SINGLE", 3)
    ranks = lm.Ranks(np.array([3, 0, 9, 9, 1]), np.array([False, True, False, True, True]))
    b = ranks.base
    assert b == 2 and lm.DIGITS == 4 and ranks.starts == 1 and ranks.rank.tolist() == [9, 2, 8, 0, 1] and ranks.none == 7
    shares = [np.exp(s) for s in ranks.shares]
    assert np.allclose([np.prod([shares[level][r // b ** (4 - level), r // b ** (3 - level) % b] for level in range(4)]) for r in ranks.rank], np.array([4, 1, 10, 10, 2]) / 27)
    assert ranks.rows[[8, 0, 9]].tolist() == [0, 1, 2] and ranks.rows[[2, 1, 15]].tolist() == [3, 3, 6]


def test_gradients():
    rng, model = np.random.default_rng(0), lm.Model(small_ranks())
    for name in model.p:
        model.p[name] = model.p[name].astype(np.float64)
    model.ranks.shares = [s.astype(np.float64) for s in model.ranks.shares]
    x, y, w, _ = lm.windows(model.ranks, [model.ranks.rank[rng.integers(0, 60, 50)]])
    _, grad = model.gradients(x, y, w)
    for name, value in model.p.items():
        at = (int(x[0, 10]), 3) if name == "E" else (int(y[w][3]) // model.ranks.base ** (lm.DIGITS - int(name[1])), 2) if name[0] == "G" else tuple(int(rng.integers(0, s)) for s in value.shape)
        value[at] += 1e-5
        up = model.gradients(x, y, w)[0]
        value[at] -= 2e-5
        down = model.gradients(x, y, w)[0]
        value[at] += 1e-5
        assert abs((up - down) / 2e-5 - grad[name][at]) < 1e-5


def brute_ids(model, sequence):
    """log10 probability of each rank, and of any that begins a word, one at a time: its window's inputs up to it, one query,
    plain softmaxes."""
    p, ranks, out = model.p, model.ranks, []
    b, step = ranks.base, lm.CONTEXT - lm.OVERLAP
    inputs = [ranks.rows[r] for r in (ranks.rank[-1], *sequence)]
    soft = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    for i, y in enumerate(sequence):
        begin = i // step * step - lm.OVERLAP  # the window's first place, in places of the text
        seen = range(max(0, begin), i + 1)
        rows = np.array([p["E"][inputs[j]] + p["P"][j - begin] for j in seen], np.float64)
        a = soft((rows @ p["K"]) @ (rows[-1] @ p["Q"]) / np.sqrt(lm.WIDTH))
        h = rows[-1] + (a @ (rows @ p["V"])) @ p["O"]
        h = h + np.maximum(h @ p["A"] + p["a"], 0) @ p["B"] + p["b"]
        first, score = soft(h @ p["U0"] + ranks.shares[0]), 0.0
        for level in range(lm.DIGITS):
            before, digit = y // b ** (lm.DIGITS - level), y // b ** (lm.DIGITS - 1 - level) % b
            state = h * p[f"G{level}"][before] if level else h
            score += np.log10(soft(state @ p[f"U{level}"] + ranks.shares[level][before])[digit])
        out.append((score, np.log10(first[: ranks.starts].sum())))
    return out


def brute_score(model, sequence):
    return sum(x for x, _ in brute_ids(model, sequence))


def test_scores_by_brute_force():
    rng, model = np.random.default_rng(1), lm.Model(small_ranks())
    for name in ("G1", "G2", "G3"):
        model.p[name] = rng.normal(1, 0.3, model.p[name].shape).astype(np.float32)
    many = [model.ranks.rank[rng.integers(0, 60, n)] for n in (1, 2, 24, 25, 26, 100, 7)]
    assert np.allclose(lm.context_scores(model, many), [brute_score(model, s) for s in many], rtol=1e-4)
    assert len(lm.context_scores(model, [])) == 0


def test_all_ranks_share_one_probability():
    model = lm.Model(small_ranks())
    start, ranks = [5, 7, 11], model.ranks
    scores = [lm.id_scores(model, [np.array([*start, r])]) for r in ranks.rank]
    assert np.isclose(sum(10 ** s[0][-1] for s in scores), 1, atol=1e-3)
    begin = [10 ** s[0][-1] for s, r in zip(scores, ranks.rank) if r < ranks.starts * ranks.base ** (lm.DIGITS - 1)]
    assert 0 < len(begin) < 60 and np.allclose([10 ** s[1][-1] for s in scores], sum(begin), atol=1e-3)


def test_each_token_is_scored_once_and_causally():
    ranks, rng = small_ranks(), np.random.default_rng(1)
    model = lm.Model(ranks)
    for n in (1, 23, 24, 25, 101):
        seq = ranks.rank[rng.integers(0, 60, n)]
        x, y, w, counts = lm.windows(ranks, [seq, seq[:1]])
        assert y[w].tolist() == [*seq, seq[0]] and counts.sum() == len(x)
        again = seq.copy()
        again[n // 2 :] = again[n // 2 :][::-1]
        one, other = (model.log_probabilities(*lm.windows(ranks, [s])[:3], lm.OVERLAP)[0] for s in (seq, again))
        assert np.allclose(one[: n // 2], other[: n // 2])


@pytest.mark.parametrize("few", [False, True])
def test_scores(docs, odd, empty, few, monkeypatch):
    if few:
        monkeypatch.setattr(lm, "FREQUENT", 300)
    monkeypatch.setattr(lm, "STEPS", 20)
    for df in (docs, odd):
        train, counts = df.filter(~lm.held_out()), Counter()
        for r in rows(train.select("text")):
            counts.update(lower_words(r["text"]))
            counts[b"\n"] += 1
        total, kinds = sum(counts.values()), len(counts)
        out = rows(lm.score_documents(df, PATH, ~lm.held_out()))
        want = []
        for r in rows(df.select("doc_id", "text")):
            w = [*lower_words(r["text"]), b"\n"]
            want.append((str(r["doc_id"]), len(w), sum(x in counts for x in w), round(sum(log10((counts[x] + 1) / (total + kinds + 1)) for x in w), 4)))
        assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in out) == sorted(want)
        assert all(r["train_tokens"] == total for r in out) and all(r["score"] < 0 for r in out)
    assert lm.score_documents(empty, PATH, ~lm.held_out()).count() == 0
    none = rows(lm.score_documents(odd, PATH, lm.F.lit(False)))
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and r["base_score"] == 0 for r in none)


def test_scores_of_whole_documents_by_brute_force(spark, monkeypatch):
    """Each word's probability out of its ids' (one at a time) and its count, frequent or rare."""
    monkeypatch.setattr(lm, "FREQUENT", 4)
    seen = {}
    real = lm.fit_model
    monkeypatch.setattr(lm, "fit_model", lambda *a: seen.setdefault("model", real(*a)))
    texts = ["The cat sat on the mat and the cat slept.", "the dog  sat\ton the unheard-of mat", "", None, "été 漢字 the the"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = {r["doc_id"]: r["score"] for r in rows(lm.score_documents(df, PATH, lm.F.col("doc_id") < 3))}
    counts, encode = Counter(), token_ids.IdEncoder(PATH).tool
    for t in texts[:3]:
        counts.update([*lower_words(t), b"\n"])
    model, z = seen["model"], Counter()
    first = lambda w: -1 if w == b"\n" else encode.encode(" " + w.decode(), add_special_tokens=False).ids[0]
    for w, c in counts.items():
        z[first(w)] += c + 1
    for i, t in enumerate(texts):
        own = [[model.ranks.rank[x] for x in encode.encode(" " + w.decode(), add_special_tokens=False).ids] for w in lower_words(t)] + [[model.ranks.rank[-1]]]
        by_id, want, at = brute_ids(model, [x for w in own for x in w]), 0.0, 0
        for word, ids in zip([*lower_words(t), b"\n"], own):
            share, here, after = (counts[word] + 1) / (z[first(word)] + 1), by_id[at][1], 0 if word == b"\n" else by_id[at + len(ids)][1]
            spelt = sum(x for x, _ in by_id[at : at + len(ids)]) - here + after
            want, at = want + log10(lm.MIXED * 10 ** (by_id[at][0] - here) * share + (1 - lm.MIXED) * 10**spelt), at + len(ids)
        assert np.isclose(out[i], want, rtol=1e-3)  # the model computes in 32 bits


def test_model_beats_the_base(docs):
    out = rows(lm.score_documents(docs, PATH, ~lm.held_out()))
    held = [r for r in out if zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2]
    assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_model_learns_from_whole_documents(spark, monkeypatch):
    """What training starts from holds no order: it is learnt from the documents' other windows."""
    monkeypatch.setattr(lm, "STEPS", 1)
    names, rng = "time people water house world school family city night group money story".split(), np.random.default_rng(5)
    train = [(i, " ".join([*names * 300])) for i in range(200)]
    test = [(1000, " ".join(names * 50)), (1001, " ".join(rng.choice(names, 600)))]
    df = spark.createDataFrame([*train, *test], "doc_id long, text string").repartition(2)
    found = {r["doc_id"]: r["score"] / r["n_tokens"] for r in rows(lm.score_documents(df, PATH, lm.F.col("doc_id") < 1000))}
    assert found[1000] > -0.3 and found[1000] > found[1001] + 0.5


def test_every_target_is_learnt_once():
    rng, ranks = np.random.default_rng(2), small_ranks()
    for n in (1, 23, 24, 25, 100):
        seq = ranks.rank[rng.integers(0, 60, n)]
        x, y, w = lm.blocks(ranks, [seq])
        assert y[w].tolist() == seq.tolist() and x[w].tolist() == ranks.rows[[ranks.rank[-1], *seq[:-1]]].tolist()
    many = [ranks.rank[rng.integers(0, 60, n)] for n in (1, 6, 7000, 300)]
    learner = lm.Learner(lm.Model(ranks))
    for part in ([], many[:2], many[2:]):
        learner.learn(part)
    learner.learn([], last=True)
    assert learner.learnt == sum(map(len, many)) and learner.rest is None


def test_word_hashes_in_blocks(monkeypatch):
    rng = np.random.default_rng(6)
    raw = b"".join(bytes(rng.choice(list(b"abc \n\t"), 40)) + b"x" * int(rng.integers(0, 30)) for _ in range(200))
    whole = substring_dedup.word_hashes(raw)
    assert len(whole) == len(raw.split()) and len(set(whole.tolist())) == len(set(raw.split()))
    for size in (1, 7, 64, 1000):
        monkeypatch.setattr(substring_dedup, "HASHED", size)
        assert (substring_dedup.word_hashes(raw) == whole).all()
    assert len(substring_dedup.word_hashes(b"")) == len(substring_dedup.word_hashes(b" \n ")) == 0


# --- the registered queries ---


DIGESTS = {
    "op1_shard": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op2_tokens": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op3_packing": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op4_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op5_substring": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op6_media": {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"},
    "op7_minhash": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op8_exact_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op9_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op10_score": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
}
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", DIGESTS)
def test_queries(spark, docs, tool, name):
    from runweave.llm.queries import QUERIES

    df = QUERIES[name](spark, SF)
    kinds = dict(df.dtypes)
    assert {c: kinds.get(c) for c in DIGESTS[name]} == DIGESTS[name]
    out, texts = rows(df), {r["doc_id"]: r["text"] for r in rows(docs)}
    assert name == "op3_packing" or sorted(r["doc_id"] for r in out) == sorted(texts)
    crc = lambda k: zlib.crc32(str(k).encode())
    if name == "op1_shard":
        assert {r["law"] for r in out} == {"rows"} and {r["grown_shard"] for r in out} == {None} and {r["shard"] for r in out} == set(range(40))
        counts = Counter(r["shard"] for r in out)
        assert max(counts.values()) - min(counts.values()) <= 1
        assert sorted((r["shard"], r["slot"]) for r in out) == [(s, i) for s in range(40) for i in range(counts[s])]
    elif name == "op2_tokens":
        at = 0
        for r in sorted(out, key=lambda r: r["doc_id"]):
            ids = [*tool.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 0]
            assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            at += len(ids)
    elif name == "op3_packing":
        total = sum(r["length"] for r in out)
        assert {r["doc_id"] for r in out} == set(texts) and max(r["sequence_id"] for r in out) == (total - 1) // packing.LENGTH
    elif name == "op4_bpe":
        for r in out:
            ids = tool.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
            assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(tool.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    elif name == "op5_substring":
        assert all(r["n_words"] == len(words(texts[r["doc_id"]])) and 0 <= r["n_removed"] <= r["n_words"] for r in out) and any(r["n_removed"] for r in out)
    elif name == "op6_media":
        assert len({(texts[r["doc_id"]] or "") for r in out}) == len({(r["payload_sha256"], r["media_sha256"], r["feature"]) for r in out})
    elif name == "op7_minhash":
        want = brute_components([(k, t) for k, t in texts.items()], 2, 80)
        assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == sorted(want) and all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)
    elif name == "op8_exact_dedup":
        last = defaultdict(list)
        for k, t in texts.items():
            last[ascii_lower(t)].append(k)
        assert all((r["keep_id"], r["group_size"]) == (max(last[ascii_lower(texts[r["doc_id"]])]), len(last[ascii_lower(texts[r["doc_id"]])])) for r in out)
    else:
        by = 3 if name == "op9_language" else 7
        assert all(r["held_out"] == (crc(r["doc_id"]) % by == (1 if by == 3 else 2)) for r in out)
        assert name == "op10_score" or all(0 <= r["score"] <= 1 for r in out)
