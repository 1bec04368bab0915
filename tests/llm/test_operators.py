"""The ten operators: brute force, round trips, held-out accuracy and the odd inputs."""

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import chat, common, decontam, langid, media, mixing, quality, records, simhash, substring, urls
from tests.helpers import rows, same_rows

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(None, None, None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t", None, "s", 3), (4, "...", "en", None, 3), (None, "some words here", "en", "s", 15), (5, "word " * 60_000, "en", "s", 300_000), (6, "twice", "en", "s", 5), (6, "twice", "en", "s", 5)]


def docs_of(spark, data, extra=False):
    df = spark.createDataFrame(data, DOCS)
    if extra:  # columns named like those the operators make
        for name in ("s1", "node", "shard", "block", "predicted", "probability", "keep", "found", "record", "_id", "component", "item_id"):
            df = df.selectExpr("*", f"'clash' AS {name}")
    return df


@pytest.fixture(scope="module")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark, small):
    return spark.read.parquet(f"{small}/labels.parquet")


@pytest.fixture(scope="module")
def benchmark(spark, small):
    return spark.read.parquet(f"{small}/benchmark.parquet")


def test_words_are_cut_alike_in_pieces(monkeypatch):
    text = ("Élan vital, über-Straße 12 ".encode() * 400)
    data = np.frombuffer(text, np.uint8)
    offsets = np.array([0, 100, 100, len(text)])
    whole = common.words(data, offsets)
    monkeypatch.setattr(common, "STEP_BYTES", 512)
    parts = common.words(data, offsets)
    assert all((a == b).all() for a, b in zip(whole, parts))
    low = common.words(np.frombuffer("élan".encode(), np.uint8), np.array([0, 5]))[0]
    assert whole[0][0] == low[0]


def test_components_match_union_find(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(None, 3), (4, None), (9, 9)]
    forest = simhash._Forest()
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    forest.add(np.array([a for a, _ in real]), np.array([b for _, b in real]))
    got = dict(rows(common.connected_components(spark.createDataFrame(edges, "src long, dst long"))))
    assert got == {n: forest.root(n) for e in real for n in e}
    assert not rows(common.connected_components(spark.createDataFrame([], "src long, dst long")))


# language identification


def test_language_accuracy_held_out(spark, small):
    docs = spark.read.parquet(f"{small.replace('sf0.001', 'sf0.01')}/documents.parquet")
    model = langid.fit(docs.where("doc_id % 2 = 0"))
    test = docs.where("doc_id % 2 = 1").toPandas()
    said, _ = langid.predict(pa.array(test["text"].tolist()), model)
    assert (np.array(said) == test["lang"].to_numpy()).mean() >= 0.97
    said, cosine = langid.predict(pa.array(["Ξεσκεπάζω την ψυχοφθόρα βδελυγμία " * 5, None, ""]), model)
    assert said == ["und"] * 3 and cosine[1] == 0


def test_centroids_match_a_plain_loop(spark, documents):
    """Trigrams, weights and nearest centroids by dictionaries."""
    import math
    from collections import Counter

    model = langid.fit(documents)
    some = documents.orderBy("doc_id").limit(30).collect()
    said, cosine = langid.predict(pa.array([r["text"] for r in some]), model)
    for r, lang, cos in zip(some, said, cosine):
        low = b" " + "".join(c.lower() if "À" <= c <= "Þ" and c != "×" else c for c in r["text"]).encode() + b" "
        low = bytes(48 if 48 <= c < 58 else c + 32 if 65 <= c < 91 else 32 if c < 128 and not 97 <= c < 123 else c for c in low)
        found = Counter()
        for k in range(len(low) - 2):
            h = (low[k] * 0x9E3779B1 ^ low[k + 1] * 0x85EBCA77 ^ low[k + 2] * 0xC2B2AE3D) & 0xFFFFFFFF
            found[((h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF) >> 20] += 1
        x = {k: (1 + math.log(v)) * model["idf"][k] for k, v in found.items()}
        norm = math.sqrt(sum(v * v for v in x.values())) or 1
        best = [sum(v * c[k] for k, v in x.items()) / norm for c in model["centres"]]
        k = int(np.argmax(best))
        assert cos == pytest.approx(best[k], abs=1e-4) and lang == (model["langs"][k] if best[k] >= model["least"][k] else "und")


def test_language_sample_counts_usable_rows_only(spark, monkeypatch):
    data = [(i, "plain words of text here" if i % 10 == 0 else ("" if i % 2 else None), "en", "s", 1) for i in range(3000)]
    data += [(i, "dirty " * 3, f"l{i}", "s", 1) for i in range(5000, 5040)]
    seen = {}
    monkeypatch.setattr(langid, "k_means", lambda x, k: seen.setdefault(len(seen), x))
    monkeypatch.setattr(langid, "MAX_LANGS", 5)
    model = langid.fit(docs_of(spark, data), per_lang=100)
    assert len(seen[0]) == 100 and len(set(model["langs"])) == 5 and "en" in model["langs"]


def test_language_odd_rows(spark):
    got = rows(langid.identify(docs_of(spark, ODD, extra=True)))
    assert len(got) == len(ODD)
    assert all(p == "und" for d, p, _ in got if d in (1, 2))
    assert not rows(langid.identify(docs_of(spark, [])))
    assert all(r[1] == "und" for r in rows(langid.identify(docs_of(spark, [(1, "text", None, None, 4)]))))


def test_trigrams_of_long_texts_count_alike():
    text = "One long text, über alles. " * 3000
    whole = [c for _, c in langid.counts(pa.array([text]))][0]
    parts = [c for _, c in langid.counts(pa.array([text]), step=1024)][0]
    assert (whole == parts).all()


# token records


def test_checksums_against_bytewise():
    assert records.crc32c(np.frombuffer(b"123456789", np.uint8), np.array([0]), np.array([9]))[0] == 0xE3069283
    rng = np.random.default_rng(0)
    size = np.array([0, 1, 3, 4, 7, 255, 256, 257, 3000])
    data = rng.integers(0, 256, size.sum()).astype(np.uint8)
    begin = np.cumsum(size) - size
    for got, b, n in zip(records.crc32c(data, begin, size).tolist(), begin, size):
        x = 0xFFFFFFFF
        for v in data[b : b + n].tolist():
            x = int(records._ONE[(x ^ v) & 255]) ^ (x >> 8)
        assert got == x ^ 0xFFFFFFFF


def test_records_round_trip_through_shards(spark, documents, tmp_path):
    import base64

    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(records.VOCABULARY, "rb"))}
    decode = tiktoken.Encoding("t", pat_str=records.PATTERN, mergeable_ranks=ranks, special_tokens={}).decode
    some = documents.limit(60).persist()
    texts = {r["doc_id"]: r["text"] for r in some.collect()}
    framed = records.records(some)
    for r in framed.collect():
        ids = records.read_record(bytes(r["record"])).tolist()
        assert ids[-1] == records.END_OF_TEXT and len(ids) == r["n_tokens"] and r["length"] == len(r["record"])
        assert decode(ids[:-1]) == texts[r["doc_id"]]
    folder = f"file://{tmp_path}/out"
    index = records.write_shards(some, folder).collect()
    assert len(index) == len(texts)
    for r in reversed(index):
        assert decode(records.read_at(folder, r["file"], r["offset"], r["length"]).tolist()[:-1]) == texts[r["doc_id"]]
    whole = records.frame([b"abcd"])[0]
    for at in (0, 9, 13, len(whole) - 1):
        broken = bytearray(whole)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            records.read_record(bytes(broken))
    some.unpersist()


def plain_ids(text, ranks):
    """Byte-level BPE by its definition: of all neighbours the pair of the lowest rank is merged, again and again."""
    import regex

    out = []
    for word in regex.findall(records.PATTERN, text):
        parts = [bytes([b]) for b in word.encode()]
        while len(parts) > 1:
            rank, k = min((ranks.get(parts[k] + parts[k + 1], 1 << 30), k) for k in range(len(parts) - 1))
            if rank == 1 << 30:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        out += [ranks[p] for p in parts]
    return out


def test_published_records_match_a_plain_encoder(spark, documents, tmp_path):
    import base64
    import glob

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(records.VOCABULARY, "rb"))}
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    folder = f"file://{tmp_path}/out"
    published = records.publish(documents.repartition(3), folder)
    for r in published.orderBy("doc_id").collect():
        assert records.read_record(bytes(r["record"])).tolist() == plain_ids(texts.pop(r["doc_id"]), ranks) + [records.END_OF_TEXT]
    assert not texts
    index = spark.read.parquet(f"{folder}/index")
    shuffled = records.read_shards(index.orderBy((index["doc_id"] * 7919) % 1000), folder)
    assert rows(shuffled) == rows(published)
    for name in glob.glob(f"{tmp_path}/out/*.bin"):  # records fill each shard end to end
        places = sorted((r["offset"], r["length"]) for r in index.where(index["file"] == name.rsplit("/", 1)[1]).collect())
        assert [o for o, _ in places] == [0, *np.cumsum([n for _, n in places])[:-1].tolist()] and sum(n for _, n in places) == len(open(name, "rb").read())


def test_records_odd_rows(spark):
    for make in (records.records, records.publish):
        got = make(docs_of(spark, ODD, extra=True)).collect()
        assert len(got) == len(ODD)
        assert all(r["n_tokens"] == 1 for r in got if r["doc_id"] in (1, 2))
        assert not rows(make(docs_of(spark, [])))


# media


@pytest.mark.parametrize("shape", [(1, 1), (8, 8), (5, 17), (33, 4)])
def test_png_round_trip_with_every_filter(shape):
    rng = np.random.default_rng(2)
    picture = rng.integers(0, 256, shape).astype(np.uint8)
    for filters in [np.full(shape[0], k) for k in range(5)] + [rng.integers(0, 5, shape[0])]:
        assert (media.decode(media.encode(picture, filters)) == picture).all()


def test_png_damage_is_told_apart(spark):
    good = media.encode(np.arange(64, dtype=np.uint8).reshape(8, 8), np.arange(8) % 5)
    flipped = bytearray(good)
    flipped[45] ^= 1
    cases = {"ok": good, "null": None, "no_png": b"GIF89a", "truncated": good[:-9], "bad_checksum": bytes(flipped)}
    data = [(i, None if v is None else bytearray(v), "x") for i, v in enumerate(cases.values())] + [(None, bytearray(good), "x"), (0, bytearray(good), "x")]
    df = spark.createDataFrame(data, "media_id long, png binary, status string")
    got = {r["media_id"]: r["status"] for r in media.hash_pictures(df).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases)
    assert media.hash_pictures(df).count() == len(data)
    assert not rows(media.hash_pictures(spark.createDataFrame([], "media_id long, png binary")))


def plain_png(samples, colour, depth, interlace=False, palette=None, kinds=None):
    """A PNG of (height, width, channels) samples by plain loops, every line with the next of the five filters."""
    import struct
    import zlib

    height, width, channels = samples.shape
    pixel = max(1, channels * depth // 8)
    grid = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)] if interlace else [(0, 0, 1, 1)]
    raw, n = b"", 0
    for x0, y0, dx, dy in grid:
        part = samples[y0::dy, x0::dx]
        before = None
        for row in part if part.size else []:
            bits = "".join(format(int(v), f"0{depth}b") for v in row.ravel())
            line = [int(bits[k : k + 8].ljust(8, "0"), 2) for k in range(0, len(bits), 8)]
            before = before or [0] * len(line)
            kind = kinds[n % len(kinds)] if kinds else n % 5
            n += 1
            out = []
            for k, v in enumerate(line):
                a, b, c = line[k - pixel] if k >= pixel else 0, before[k], before[k - pixel] if k >= pixel else 0
                p = a + b - c
                near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                out.append((v - (0, a, b, (a + b) // 2, near)[kind]) % 256)
            raw += bytes([kind, *out])
            before = line
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    half = zlib.compress(raw)
    body = chunk(b"IDAT", half[: len(half) // 2]) + chunk(b"IDAT", half[len(half) // 2 :])
    colours = chunk(b"PLTE", bytes(int(v) for c in palette for v in c)) if palette is not None else b""
    return media.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, int(interlace))) + colours + body + chunk(b"IEND", b"")


def plain_brightness(pixel, colour, depth, palette):
    top = (1 << depth) - 1
    v = [x >> 8 if depth == 16 else x * 255 / top if colour != 3 else x for x in map(int, pixel)]
    if colour == 3:
        v = [int(x) for x in palette[int(v[0])]]
    elif colour in (4, 6):
        v = [x * v[-1] / 255 for x in v[:-1]]
    return v[0] if len(v) == 1 else 0.299 * v[0] + 0.587 * v[1] + 0.114 * v[2]


KINDS = [(0, d) for d in (1, 2, 4, 8, 16)] + [(2, 8), (2, 16), (3, 1), (3, 2), (3, 4), (3, 8), (4, 8), (4, 16), (6, 8), (6, 16)]


@pytest.mark.parametrize("interlace", [False, True])
@pytest.mark.parametrize("colour,depth", KINDS)
def test_every_kind_of_png_matches_plain_loops(colour, depth, interlace):
    rng = np.random.default_rng(colour * 100 + depth)
    for shape in ((1, 1), (3, 2), (13, 19)):
        samples = rng.integers(0, 1 << depth, (*shape, media.CHANNELS[colour]))
        palette = rng.integers(0, 256, (1 << min(depth, 8), 3)) if colour == 3 else None
        want = np.array([[plain_brightness(p, colour, depth, palette) for p in row] for row in samples])
        data = plain_png(samples, colour, depth, interlace, palette)
        for most in (1, 64, 1 << 20):  # whatever the bands
            assert np.allclose(media.decode(data, most), want)
            (height, width), small = media.shrink(data, most)
            assert (height, width) == shape and np.allclose(small, media._areas(height) @ want @ media._areas(width).T)


def plain_hash(picture):
    """Area averages, cosine transform and signs by loops over numbers."""
    import math

    height, width = len(picture), len(picture[0])
    share = lambda i, j, n: max(0.0, min((i + 1) * n / 32, j + 1) - max(i * n / 32, j))
    small = [[sum(share(y, j, height) * share(x, i, width) * picture[j][i] for j in range(height) for i in range(width)) * 32 / height * 32 / width for x in range(32)] for y in range(32)]
    scale = lambda k: math.sqrt((1 if k == 0 else 2) / 32)
    low = [scale(u) * scale(v) * sum(small[y][x] * math.cos(math.pi * u * (2 * y + 1) / 64) * math.cos(math.pi * v * (2 * x + 1) / 64) for y in range(32) for x in range(32)) for u in range(8) for v in range(8)]
    median = sorted(low[1:])[31]
    return "".join("1" if v > median + 1e-6 else "0" for v in low), [abs(v - median) for v in low]


def test_hashes_match_plain_loops(spark, monkeypatch):
    rng = np.random.default_rng(12)
    shapes, data = [(8, 8), (9, 5), (40, 33)], []
    for k, shape in enumerate(shapes):
        data.append((k, bytearray(plain_png(rng.integers(0, 256, (*shape, 3)), 2, 8, interlace=k == 1))))
    df = spark.createDataFrame(data, "media_id long, png binary")
    got = {r["media_id"]: r for r in media.hash_pictures(df).collect()}
    for k, png in data:
        assert got[k]["status"] == "ok" and (got[k]["height"], got[k]["width"]) == shapes[k]
        want, clear = plain_hash(media.decode(bytes(png)).tolist())
        said = "".join(f"{b:08b}" for b in got[k]["hash"])
        assert all(a == b for a, b, d in zip(said, want, clear) if d > 1e-5)
    batch = pa.RecordBatch.from_arrays([pa.array([k for k, _ in data]), pa.array([bytes(v) for _, v in data], pa.binary())], ["media_id", "png"])
    monkeypatch.setattr(media, "HELD_BYTES", 1)  # all pictures are now too large to be held
    (again,) = media._hash(iter([batch]))
    assert again.column("hash").to_pylist() == [got[k]["hash"] for k, _ in data]


def test_every_fault_has_its_status(spark):
    import struct
    import zlib

    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    png = lambda head, raw, more=b"": media.SIGNATURE + chunk(b"IHDR", head) + more + chunk(b"IDAT", raw) + chunk(b"IEND", b"")
    head = lambda w, h, depth=8, colour=0, interlace=0: struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, interlace)
    packed = zlib.compress(bytes(12))
    cases = [
        ("ok", png(head(3, 3), packed)), ("bad_header", png(head(0, 3), packed)), ("bad_header", png(head(3, 3, 3), packed)), ("bad_header", png(head(3, 3, 8, 5), packed)),
        ("bad_header", png(head(3, 3, interlace=2), packed)), ("bad_header", png(b"short", packed)), ("bad_header", media.SIGNATURE + chunk(b"IEND", b"")),
        ("bad_stream", png(head(3, 4), packed)), ("bad_stream", png(head(3, 2), packed)), ("bad_stream", png(head(3, 3), packed[:-1])), ("bad_stream", png(head(3, 3), packed[:-1] + b"!")), ("bad_stream", png(head(3, 3), b"junk")),
        ("bad_stream", png(head(100_000, 1_000_000), packed)), ("bad_filter", png(head(3, 3), zlib.compress(b"\x09" + bytes(11)))), ("bad_palette", png(head(3, 3, 8, 3), packed)),
        ("bad_palette", png(head(3, 3, 8, 3), zlib.compress(bytes(11) + b"\x07"), chunk(b"PLTE", bytes(6)))), ("ok", png(head(3, 3, 8, 3), packed, chunk(b"PLTE", bytes(6)))), ("no_png", b""), ("truncated", media.SIGNATURE),
        ("ok", png(head(9000, 9000), zlib.compress(bytes(9001 * 9000)))),
    ]
    df = spark.createDataFrame([(k, bytearray(v)) for k, (_, v) in enumerate(cases)], "media_id long, png binary")
    got = {r["media_id"]: (r["status"], r["hash"]) for r in media.hash_pictures(df).collect()}
    assert [got[k][0] for k in range(len(cases))] == [s for s, _ in cases]
    assert all((h is None) == (s != "ok") for s, h in got.values())


def test_hash_is_close_for_alike_pictures():
    y, x = np.mgrid[0:64, 0:64] / 64
    a = 128 + 60 * np.sin(7 * x + 2 * y) + 50 * np.cos(5 * y * x)
    rng = np.random.default_rng(3)
    other = rng.integers(0, 256, (64, 64)).astype(float)
    bits = lambda p: np.unpackbits(np.frombuffer(media.perceptual(p), np.uint8))
    assert (bits(a) != bits(a * 0.8 + 10 + rng.normal(0, 2, a.shape))).sum() <= 6
    assert (bits(a) != bits(other)).sum() >= 16
    assert media.perceptual(np.full((5, 5), 7.0)) in (bytes(8), b"\x80" + bytes(7))


# SimHash near-duplicates


def brute_groups(ids, sigs, some, threshold):
    forest = simhash._Forest()
    for k in range(len(ids)):
        if some[k]:
            near = np.flatnonzero((np.bitwise_count(sigs[k + 1 :] ^ sigs[k]).sum(1) <= threshold) & some[k + 1 :]) + k + 1
            forest.add(np.full(len(near), ids[k]), ids[near])
    return {int(i): forest.root(int(i)) for i in ids if forest.root(int(i)) != i}


def plain_signature(text):
    """A signature by integers alone: words by a regular expression, bits by counting; None without words."""
    import re

    whole, base = (1 << 64) - 1, 0x9E3779B97F4A7C15 | 1

    def mixed(h):
        h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & whole
        h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & whole
        return h ^ (h >> 31)

    lower = re.sub("[A-ZÀ-ÖØ-Þ]", lambda m: m[0].lower(), text)
    found = {w.encode() for w in re.findall("[0-9a-z\x80-\U0010ffff]+", lower)}
    votes = [0] * 128
    seen = {mixed(sum((c + 1) * pow(base, k, 1 << 64) for k, c in enumerate(w)) & whole) >> 20 for w in found}
    for h in map(mixed, seen):
        raw = mixed(h).to_bytes(8, "little") + mixed((h + 0x9E3779B97F4A7C15) & whole).to_bytes(8, "little")
        for k in range(128):
            votes[k] += raw[k // 8] >> (7 - k % 8) & 1
    return sum(1 << k for k in range(128) if 2 * votes[k] > len(seen)) if seen else None


def test_near_duplicates_match_brute_force(spark, documents):
    """Signatures, distances and groups all made anew, from the operator's docstring."""
    pdf = documents.select("doc_id", "text").toPandas().sort_values("doc_id")
    signed = {d: s for d, t in zip(pdf["doc_id"], pdf["text"]) if (s := plain_signature(t)) is not None}
    group = {d: d for d in signed}
    for d in sorted(signed):
        for other in sorted(signed):
            if other < d and (signed[d] ^ signed[other]).bit_count() <= simhash.THRESHOLD and group[d] != group[other]:
                gone, stays = max(group[d], group[other]), min(group[d], group[other])
                group = {k: stays if v == gone else v for k, v in group.items()}
    want = {d: g for d, g in group.items() if d != g}
    got = {r["doc_id"]: (r["kept_doc_id"], r["group_size"]) for r in simhash.near_duplicates(documents).collect()}
    assert {d: g for d, (g, _) in got.items()} == want and got
    assert all(n == 1 + sum(g == k for k in want.values()) for g, n in got.values())


def test_large_buckets_and_other_plans_match_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, (3, 2)).astype(np.uint64)
    sigs = []
    for k in range(400):
        s = base[k % 3].copy()
        for bit in rng.integers(0, 128, rng.integers(0, 12)):
            s[bit // 64] ^= np.uint64(1 << int(bit % 64))
        sigs.append(s)
    sigs = np.array(sigs)
    ids = np.arange(400)
    df = spark.createDataFrame([(int(i), int(a), int(b)) for i, (a, b) in zip(ids, sigs.view(np.int64))], "node long, s1 long, s2 long")
    want = brute_groups(ids, sigs, np.ones(400, bool), 16)
    got = {a: b for a, b in rows(common.connected_components(simhash.near_pairs(df))) if a != b}
    assert got == want


def test_allocation_keeps_the_pigeonhole_at_every_size(spark, documents):
    signed = simhash.sign(documents)
    second = simhash.moments(signed.selectExpr("doc_id AS node", "s1", "s2").dropDuplicates(["s1", "s2"]))
    plans = {k: simhash.allocate(second, n=2.0**k) for k in range(10, 36, 3)}
    for groups, thresholds in plans.values():
        assert sorted(b for g in groups for b in g) == list(range(128))
        assert sum(t + 1 for t in thresholds) >= simhash.THRESHOLD + 1
    assert any(len(set(t)) > 1 for _, t in plans.values())  # unequal thresholds
    made = [sum(simhash._ball(len(g), t // 2) for g, t in zip(*p) if t >= 0) for p in plans.values()]
    assert made == sorted(made) and made[-1] < 2200
    assert plans[10] == simhash.allocate(second, n=1024.0)


@pytest.mark.parametrize("size", [2.0**12, 2.0**18, 2.0**22, 2.0**30])
def test_every_plan_finds_the_same_pairs(spark, monkeypatch, size):
    """The plans of other sizes, run on few signatures."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**63, (40, 2)).astype(np.uint64)
    sigs = np.repeat(base, 6, 0)
    for k in range(len(sigs)):
        for bit in rng.choice(128, rng.integers(0, 14), replace=False):
            sigs[k, bit // 64] ^= np.uint64(1 << int(bit % 64))
    ids = np.arange(len(sigs))
    df = spark.createDataFrame([(int(i), int(a), int(b)) for i, (a, b) in zip(ids, sigs.view(np.int64))], "node long, s1 long, s2 long")
    whole, bits = simhash.allocate, simhash.key_bits
    monkeypatch.setattr(simhash, "allocate", lambda second, threshold: whole(second, threshold, size))
    monkeypatch.setattr(simhash, "key_bits", lambda width, n: bits(width, size))
    want = brute_groups(ids, sigs, np.ones(len(ids), bool), simhash.THRESHOLD)
    got = {a: b for a, b in rows(common.connected_components(simhash.near_pairs(df))) if a != b}
    assert got == want and len(want) > 100


def test_near_duplicates_odd_rows(spark):
    got = rows(simhash.near_duplicates(docs_of(spark, ODD + [(9, "some words here", "x", "y", 1), (8, "some words here", "x", "y", 1)], extra=True)))
    assert got == [(9, 8, 2)]
    assert not rows(simhash.near_duplicates(docs_of(spark, [])))
    kept = simhash.deduplicate(docs_of(spark, ODD + [(9, "a b", "x", "y", 1), (8, "a b", "x", "y", 1)]))
    assert kept.columns == docs_of(spark, []).columns and kept.count() == len(ODD) + 1


# substring dedup


def test_repeats_match_sql(documents, duck):
    same_rows(substring.remove_repeats(documents), duck, substring.ORACLE)


def test_a_passage_inside_other_text_goes_where_it_comes_again(spark):
    passage = "The old harbour lay quiet under a thin grey mist that morning. Nobody on the long pier had seen the boats leave before dawn. Only the gulls knew why, and they said nothing. A bell rang twice across the water and then stopped for good."
    a, b = f"Here it begins.\n{passage} Then it ends in a quite different way", f"another opening without a stop {passage} and goes on"
    data = [(70, b, "en", "s", 1), (30, a, "en", "s", 1), (40, "Clean text stays. It does.", "en", "s", 1), *ODD]
    got = {r["doc_id"]: r for r in substring.remove_repeats(docs_of(spark, data, extra=True)).collect()}
    assert got[30]["text"] == a and got[70]["text"].count("harbour") == 0
    assert got[70]["kept_doc_ids"] == [30] and got[40]["text"] == "Clean text stays. It does." and got[40]["kept_doc_ids"] == []
    start, end = map(int, got[70]["removed_spans"].split(":"))
    assert b[:start] + b[end:] == got[70]["text"]
    assert got[1]["text"] is None and got[2]["text"] == ""
    assert not rows(substring.remove_repeats(docs_of(spark, [])))


def test_every_word_of_a_passage_counts_whatever_its_lines(spark):
    names = " ".join(f"Name{i}" for i in range(30))  # thirty units of one word
    verse = "\n\n".join(f"one little line of verse number {k} ends" for k in range(9))
    data = [(1, f"Some beginning here.\n{names}\n", "en", "s", 1), (2, f"Quite another start.\n{names}\nAnd end", "en", "s", 1)]
    data += [(3, f"A third one.\n{verse}\nEnd.", "en", "s", 1), (4, f"A fourth.\n\n{verse}\n\nOther.", "en", "s", 1)]
    data += [(5, "Name3 Name9 Name1 were alone. " * 1 + "one little line of verse number 3 ends", "en", "s", 1)]  # chance repeats stay
    got = {r["doc_id"]: r for r in substring.remove_repeats(docs_of(spark, data)).collect()}
    assert got[1]["removed_words"] == 0 and got[2]["removed_words"] == 30 and got[2]["text"] == "Quite another start.\nAnd end" and got[2]["kept_doc_ids"] == [1]
    assert got[4]["text"].split() == ["A", "fourth.", "Other."] and got[4]["kept_doc_ids"] == [3]
    assert got[5]["removed_words"] == 0
    loose = {r["doc_id"]: r for r in substring.remove_repeats(docs_of(spark, data), min_words=1).collect()}
    assert loose[5]["text"] == "Name1 were alone. "


def test_a_text_that_repeats_itself_keeps_the_first(spark, duck):
    line = " ".join(f"w{i}" for i in range(24)) + ".\n"
    data = [(9, line * 3 + "end", "en", "s", 1), (9, line * 3 + "end", "en", "s", 1), (11, line, "en", "s", 1), (8, "Ab. " * 100, "en", "s", 1)]
    got = {r["doc_id"]: r for r in substring.remove_repeats(docs_of(spark, data)).collect()}
    assert got[9]["text"] == line + "end" and got[9]["kept_doc_ids"] == [] and got[11]["text"] == "" and got[11]["kept_doc_ids"] == [9]
    assert got[8]["text"] == "Ab. " * 20


# quality


def test_quality_held_out(spark, small):
    big = small.replace("sf0.001", "sf0.01")
    d, y = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    pdf = d.join(y, "doc_id").select("doc_id", "text", "quality").toPandas().sort_values("doc_id")
    train, test = pdf[pdf["doc_id"] % 4 != 0], pdf[pdf["doc_id"] % 4 == 0]
    model = quality.train(train["text"].tolist(), train["quality"].to_numpy(np.float32))
    p = quality.probabilities(pa.array(test["text"].tolist()), model | {"pairs": quality._pairs(model["tables"])})
    good = test["quality"].to_numpy() == 1
    assert (p[good] >= quality.REJECT).mean() >= 0.98 and (p[~good] < quality.REJECT).mean() >= 0.75


def test_network_matches_a_plain_loop():
    rng = np.random.default_rng(5)
    model = {"tables": rng.normal(size=(6, 256, 16)).astype(np.float32), "bias": rng.normal(size=16).astype(np.float32), "weight": rng.normal(size=32) * 0.1, "offset": np.zeros(1)}
    texts = ["", "short", "many words in one text " * 40]
    got = quality.probabilities(pa.array(texts), model | {"pairs": quality._pairs(model["tables"])})
    for text, p in zip(texts, got):
        raw = text.encode()
        blocks = (len(raw) + 6 + 127) // 128
        data = np.frombuffer(raw + bytes(blocks * 128 + 6 - len(raw)), np.uint8)
        y = np.array([sum(model["tables"][k, data[i + k]] for k in range(6)) for i in range(blocks * 128)]).reshape(blocks, 128, 16).max(1) + model["bias"]
        chunk = np.array([np.maximum(np.maximum(y[i], y[min(i + 1, blocks - 1)]), 0) for i in range(blocks)])
        z = np.concatenate([chunk.max(0), chunk.mean(0)]) @ model["weight"]
        assert p == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4)


def test_quality_odd_rows(spark, labels):
    bad = spark.createDataFrame([(None, 1, 0), (4, None, 0), (4, 7, 0)], "doc_id long, quality int, toxic int")
    got = rows(quality.classify(docs_of(spark, ODD, extra=True), bad))
    assert len(got) == len(ODD) and all(r[1] == pytest.approx(1) and r[2] for r in got)
    two = spark.createDataFrame([(4, 0, 0), (6, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.classify(docs_of(spark, ODD), two).count() == len(ODD)
    assert not rows(quality.classify(docs_of(spark, []), two))
    assert quality.keep_good(docs_of(spark, ODD), bad).columns == docs_of(spark, []).columns


# URL filters


def test_urls_match_sql(spark, small, duck):
    got = urls.filter_urls(*urls.with_links(spark.read.parquet(f"{small}/pages.parquet")))
    same_rows(got, duck, urls.oracle())
    sizes = [r["count"] for r in got.groupBy("component").count().collect()]
    assert max(sizes) >= 3 and {r["decision"] for r in got.collect()} >= {"block", "keep"}


def test_decisions_spread_and_allow_wins(spark):
    page = lambda i, url, canonical=None, refresh=None: (i, url, (f'<link href="{canonical}" rel="canonical">' if canonical else "") + (f'<meta http-equiv="refresh" content="0; url={refresh}">' if refresh else ""), "x")
    data = [
        page(1, "http://a.test/x", canonical="https://www.b.test/y"), page(2, "https://m.b.test/y/#top"), page(3, "http://c.test/z", refresh="http://bad.test/1"),
        page(4, "http://c.test/z?utm_source=q"), page(5, "http://d.test/1", canonical="http://sub.bad.test/2"), page(6, "http://good.test/", canonical="http://d.test/1.html"),
        page(7, None), page(8, "  "), (9, "http://e.test", None, "x"), page(1, "http://a.test/x", canonical="https://www.b.test/y"),
    ]
    df = spark.createDataFrame(data, "page_id long, url string, html string, component string")
    redirects = spark.createDataFrame([("http://b.test/y", "http://bad.test/9"), (None, "http://a.test"), ("http://f.test", None)], "src_url string, dst_url string")
    got = urls.filter_urls(df, redirects, ["bad.test"], [], ["good.test"], []).collect()
    said = {r["page_id"]: r["decision"] for r in got}
    assert said == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "keep", 8: "keep", 9: "keep"}
    assert len(got) == len(data) and all(r["component"] is None for r in got if r["page_id"] in (7, 8))
    assert not rows(urls.filter_urls(spark.createDataFrame([], "page_id long, url string, html string")))


def test_relative_links_and_all_tags_count(spark):
    links = ["/root?a=1&amp;b=2", "side", "../up", "./../../../top", "?q=1", "//other.test/x", "#here", "mailto:a@b", "HTTPS://abs.test/Y", "a/b/../c.html"]
    df = spark.createDataFrame([("http://www.h.test/d/e/f?z#w", t) for t in links], "url string, t string")
    got = [r[0] for r in df.select(urls.normal(urls.resolve(df["url"], df["t"]))).collect()]
    assert got == ["h.test/root?a=1&b=2", "h.test/d/e/side", "h.test/d/up", "h.test/top", "h.test/d/e/f?q=1", "other.test/x", None, None, "abs.test/Y", "h.test/d/e/a/c"]
    two = '<link rel=canonical href=one><p>' + "x" * 200_000 + '<link href="/two" rel="canonical"><meta http-equiv="refresh" content="3;URL=/three">'
    pages = [(1, "http://a.test/", two), (2, "http://a.test/one", ""), (3, "http://bad.test/" + "y" * 50_000, '<link rel="canonical" href="http://a.test/two/">'), (4, "a.test/three", None)]
    said = urls.filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), None, ["bad.test"], [], [], []).collect()
    assert {r["decision"] for r in said} == {"block"} and len({r["component"] for r in said}) == 1


# mixing


def test_mixing_matches_sql(documents, duck):
    same_rows(mixing.select_blocks(documents), duck, mixing.oracle())


def test_quotas_are_sainte_lague(spark):
    data = [(i, "one two three four five", None, s, 0) for s, lo, n in (("a", 0, 400), ("b", 1000, 400), ("c", 2000, 400)) for i in range(lo, lo + n)]
    got = mixing.select_blocks(docs_of(spark, data), {"a": 5.0, "b": 3.0, "c": 0.0}, block_tokens=50, shard_rows=5000, fraction=0.2, seed=1)
    quota = {r["source"]: r["quota"] for r in got.collect()}
    places, have = 24, {"a": 0, "b": 0}
    for _ in range(places):
        best = max(have, key=lambda s: ({"a": 5.0, "b": 3.0}[s] / (2 * have[s] + 1), s == "a"))
        have[best] += 1
    assert quota == have


def test_shares_of_tokens_hold_with_very_long_documents(spark):
    """Two sources of as many tokens, one in short documents and one in long ones, and one very long one in each."""
    data = [(i, "w " * 40, None, "short", 0) for i in range(3000)] + [(10_000 + i, "w " * 2000, None, "long", 0) for i in range(60)]
    data += [(20_000, "w " * 9000, None, "short", 0), (20_001, "w " * 9000, None, "long", 0)]
    for weights, want in (({"short": 1.0, "long": 1.0}, 0.5), ({"short": 3.0, "long": 1.0}, 0.75), ({"short": 1.0, "long": 4.0}, 0.2)):
        got = mixing.select_blocks(docs_of(spark, data), weights, block_tokens=500, shard_rows=10_000, fraction=0.5, seed=2).groupBy("source").agg({"n_tokens": "sum", "quota": "max"})
        have = {r["source"]: r["sum(n_tokens)"] for r in got.collect()}
        # half a very long document is 4,500 of 129,000 tokens
        assert abs(have["short"] / sum(have.values()) - want) < 0.04
        assert abs(sum(have.values()) - 129_000) < 2 * 4500


def test_shards_follow_the_rows_and_ties_go_by_name(spark):
    data = [(i, "a b c", None, "bcd"[i % 3], 0) for i in range(900)]
    got = mixing.select_blocks(docs_of(spark, data), block_tokens=30, shard_rows=100).collect()
    assert {r["shard"] for r in got} == set(range(9))
    for shard in range(9):
        quota = {r["source"]: r["quota"] for r in got if r["shard"] == shard}
        assert max(quota.values()) - min(quota.values()) <= 1 and quota["b"] >= quota["c"] >= quota["d"]


def test_mixing_odd_rows(spark):
    got = mixing.select_blocks(docs_of(spark, ODD, extra=True), fraction=1.0)
    assert got.count() == len(ODD)
    assert mixing.mix(docs_of(spark, ODD), fraction=1.0).count() == len(ODD)
    assert not rows(mixing.select_blocks(docs_of(spark, [])))


# decontamination


def longest_common(a, b):
    """Lengths of the longest common subsequences of rows of a and b, by the textbook recurrence for all pairs at once."""
    best = np.zeros((b.shape[1] + 1, len(a)), np.int16)
    for i in range(a.shape[1]):
        diagonal = best[0].copy()
        for j in range(b.shape[1]):
            up = best[j + 1].copy()
            same = (a[:, i] == b[:, j]) & (a[:, i] >= 0)
            best[j + 1] = np.where(same, diagonal + 1, np.maximum(up, best[j]))
            diagonal = up
    return best[-1]


def brute_leaks(docs, items):
    """Every passage against every piece, as leaks' docstring has it; (doc_id, item_id) pairs."""
    import re

    cut = lambda t: re.findall("[0-9a-z\x80-\U0010ffff]+", t.lower())
    number = {}
    for w in {w for _, t in items for w in cut(t)}:
        number[w] = len(number)
    pieces = []
    for item, text in items:
        w = [number[x] for x in cut(text)]
        ends = [m.end() for m in re.finditer(r"[.!?]\s+", text)]
        answer = len(cut(text[: ends[-1]])) if ends else 0
        parts = -(-len(w) // 60)
        for k in range(parts):
            lo, hi = len(w) * k // parts, len(w) * (k + 1) // parts
            pieces.append((item, w[lo:hi], min(max(answer - lo, 0), hi - lo)))
    passages = []
    for doc, text in docs:
        w = [number.get(x, -1) for x in cut(text)]
        for at in range(0, len(w), 24):
            some = w[max(at - 24, 0) : at + 72]
            passages.append((doc, some + [-1] * (96 - len(some))))
    text = np.array([p for _, p in passages])
    found = set()
    for item, w, answer in pieces:
        live = np.flatnonzero(np.isin(text, w).sum(1) >= min(len(w) / 2, len(w)))
        if not len(live):
            continue
        share = longest_common(text[live], np.tile(w, (len(live), 1))) / len(w)
        tail = longest_common(text[live], np.tile(w[answer:], (len(live), 1))) / len(w[answer:]) if w[answer:] else np.zeros(len(live))
        yes = share >= 1 if len(w) < 8 else (share >= 0.75) | ((share >= 0.5) & (tail >= 0.8))
        found |= {(passages[k][0], item) for k in live[yes]}
    return found


def test_leaks_match_brute_force(documents, benchmark):
    docs, items = ([tuple(r) for r in df.collect()] for df in (documents.select("doc_id", "text"), benchmark.select("item_id", "text")))
    got = decontam.leaks(documents, benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == brute_leaks(docs, items) and got
    assert all(decontam.COSINE - 1e-6 <= r["cosine"] <= 1 and r["share"] <= 1 for r in got)


def test_edited_items_match_brute_force_beyond_the_rank(spark, documents, monkeypatch):
    """Hundreds of pieces, half of them edited, with few dimensions, and searched for in several groups."""
    rng = np.random.default_rng(13)
    docs = [(r["doc_id"], r["text"]) for r in documents.orderBy("doc_id").limit(120).collect()]
    long = [t.split(" ") for _, t in docs if len(t.split(" ")) > 80]
    items = []
    for k in range(300):
        w = long[int(rng.integers(len(long)))]
        n = int(rng.integers(14, 60))
        at = int(rng.integers(0, len(w) - n))
        some = [x if k % 2 or rng.random() > 0.2 else long[0][int(rng.integers(60))] for x in w[at : at + n]]
        items.append((k, " ".join(some)))
    items += items[:3]  # repeated items are one
    few = spark.createDataFrame(docs + docs[:5], "doc_id long, text string")
    want = brute_leaks(docs, items)
    for rank, group in ((24, decontam.GROUP_CHARS), (240, 20_000)):
        monkeypatch.setattr(decontam, "GROUP_CHARS", group)
        got = [(r["doc_id"], r["item_id"]) for r in decontam.leaks(few, spark.createDataFrame(items, "item_id long, text string"), rank).collect()]
        assert len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.97 * len(want) > 200


def test_common_subsequences_match_plain_dynamic_programming():
    rng = np.random.default_rng(6)
    pieces = [rng.integers(0, 9, n).astype(np.int32) for n in (1, 12, 60)]
    bench = decontam.Bench(np.arange(9, dtype=np.uint64), np.arange(3), pieces, [0, 5, 40])
    verifier = decontam.Verifier(bench)
    passage = rng.integers(-1, 9, (30, 96))
    which = rng.integers(0, 3, 30)

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for k, y in enumerate(b):
                new.append(row[k] + 1 if x == y else max(row[k + 1], new[k]))
            row = new
        return row[-1]

    assert verifier.common(passage, which, verifier.full).tolist() == [lcs(p, pieces[w]) for p, w in zip(passage.tolist(), which)]


def test_matrices_add_up_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(decontam, "FAN_IN", 3)
    df = spark.range(0, 100, 1, 20).selectExpr("cast(cast(id AS string) AS binary) AS ids")
    total = decontam._summed(df, lambda batches: np.full((300, 100), float(sum(b.num_rows for b in batches))), 300, 100)
    assert (total == 100).all()


def test_both_ways_to_the_sketch_agree(documents, benchmark, monkeypatch):
    bench = decontam.prepare(benchmark)
    numbered = decontam.number(documents, bench).persist()
    n, weight = decontam.weights(numbered, len(bench.vocabulary))
    one = decontam.latent(numbered, bench, n, weight, 20)
    monkeypatch.setattr(decontam, "PAIR_WORDS", 0)
    other = decontam.latent(numbered, bench, n, weight, 20)
    assert np.abs(one @ one.T - other @ other.T).max() < 1e-3
    numbered.unpersist()


def test_paraphrases_are_found_and_others_left(spark, documents, benchmark):
    item = benchmark.orderBy("item_id").first()
    w = item["text"].split()
    changed = " ".join(x if i % 6 else "otherword" for i, x in enumerate(w))
    clean = " ".join(reversed(w))
    extra = spark.createDataFrame([(10**9, "Before it. " + changed + " After it.", "en", "s", 1), (10**9 + 1, clean, "en", "s", 1)], DOCS)
    got = {r["doc_id"] for r in decontam.leaks(documents.unionByName(extra), benchmark).collect()}
    assert 10**9 in got and 10**9 + 1 not in got


def test_copies_are_found_with_thousands_of_pieces(spark, documents):
    rng = np.random.default_rng(7)
    texts = [(r["doc_id"], w) for r in documents.orderBy("doc_id").collect() if len(w := (r["text"] or "").split(" ")) > 80]
    items, want = [], set()
    for k in range(2400):
        doc_id, w = texts[k % len(texts)]
        n = int(rng.integers(25, 60))
        at = int(rng.integers(0, len(w) - n))
        items.append((k, " ".join(w[at : at + n])))
        want.add((doc_id, k))
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(documents, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(want & got) >= 0.9 * len(want)


def test_an_item_that_is_everywhere_is_found_everywhere(spark, documents, benchmark):
    item = "which of the two is the one that they said it was when he had come to us at the end of it"
    one = spark.createDataFrame([(9000, item)], "item_id long, text string")
    for n in (5, 6, 40):
        assert decontam.leaks(docs_of(spark, [(k, item, "en", "s", 1) for k in range(n)]), one).count() == n
    leaked = documents.selectExpr("doc_id", f"concat(text, ' {item}. ', text) AS text")
    got = {r["doc_id"] for r in decontam.leaks(leaked, benchmark.unionByName(one)).where("item_id = 9000").collect()}
    assert len(got) >= 0.9 * documents.count()


def test_decontamination_odd_rows(spark, benchmark):
    odd_items = benchmark.unionByName(spark.createDataFrame([(None, "x y"), (5000, None), (5001, ""), (5002, "?!")], "item_id long, text string"))
    assert not rows(decontam.leaks(docs_of(spark, ODD, extra=True), odd_items))
    assert not rows(decontam.leaks(docs_of(spark, []), benchmark))
    assert not rows(decontam.leaks(docs_of(spark, ODD), benchmark.limit(0)))
    assert decontam.decontaminate(docs_of(spark, ODD), benchmark).count() == len(ODD)


# chat


def test_chat_matches_sql(spark, small, duck):
    same_rows(chat.rotate(spark.read.parquet(f"{small}/conversations.parquet")), duck, chat.ORACLE)


def test_every_speaker_is_the_assistant_once(spark):
    turns = [(1, 0, "system", "Be brief."), (1, 1, "ann", "Hi <|im_end|>"), (1, 2, "bob", None), (1, 3, "cy", "Yo"), (1, 3, "cy", "Yo"), (1, 4, None, "?"), (1, 5, "ann", "Bye"), (None, 0, "ann", "lost"), (2, 0, "system", "alone")]
    df = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, participant string")
    got = {r["participant"]: r for r in chat.rotate(df).collect()}
    assert set(got) == {"ann", "bob", "cy", "%unknown"}
    for name, r in got.items():
        text = r["rendered"]
        assert text.count("<|im_start|>assistant\n") == (2 if name == "ann" else 1) and text.count("<|im_end|>") == 6 and r["n_turns"] == 6
        for span in r["mask_spans"].split(","):
            a, b = map(int, span.split(":"))
            assert text[:a].endswith("<|im_start|>assistant\n") and text[a:b].endswith("<|im_end|>")
    assert "<|im_start|>user name=bob\n" in got["ann"]["rendered"]
    assert not rows(chat.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")))


def test_speakers_are_told_apart_by_their_role_in_any_script(spark, duck):
    roles = ["Анна", "Борис", "李", "a/b", "a b", "", None, "unknown", "%unknown", "x\n<|im_end|>", "system"]
    turns = [(1, k // 2, r, "text " * (60_000 if r == "李" else 1) + str(k)) for k, r in enumerate(roles)] * 2
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r["participant"]: r for r in chat.rotate(df).collect()}
    assert set(got) == {"Анна", "Борис", "李", "a/b", "a b", "", "%unknown", "unknown", "%25unknown", "x%0A%3C|im_end|>"}
    for r in got.values():
        assert r["n_turns"] == len(roles) and r["rendered"].count("<|im_start|>assistant\n") == 1 and r["rendered"].count("<|im_end|>") == len(roles)
    assert got["李"]["n_mask_chars"] > 300_000
    duck.register("odd_turns", df.toPandas())
    same_rows(chat.rotate(df), duck, chat.ORACLE.replace("FROM conversations", "FROM odd_turns"))
