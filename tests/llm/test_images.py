"""Image copies: crops, edits, and images that have nothing in common."""

import numpy as np
from pyspark.sql import functions as F

from vectriage.llm import images


def scene(seed, h=160, w=200):
    rng = np.random.default_rng(seed)
    im = np.full((h, w), 120.0)
    for _ in range(60):
        y, x, a, b = rng.integers(0, h - 10), rng.integers(0, w - 10), rng.integers(5, 40), rng.integers(5, 40)
        im[y : y + a, x : x + b] = rng.integers(0, 255)
    return im.astype(np.uint8)


def pgm(im):
    return f"P5\n{im.shape[1]} {im.shape[0]}\n255\n".encode() + im.tobytes()


def groups(spark, rows, **options):
    df = spark.createDataFrame([(k, bytearray(v) if v is not None else None) for k, v in rows], "id long, image binary")
    return images.find_copies(df, "id", "image", **options).collect()


def brute(rows):
    """{id: (component, links)} of rows (id, image): all pairs of images, and of their corners, one by one."""
    found = {}
    for k, data in rows:
        im = images.decode_pgm(data)
        owner, scale, turn, y, x, d = images.describe([im])
        inner = ~images.of_frame([im], owner, scale, y, x)
        corners = sorted({(int(s), int(t), int(a), int(b), int(p) << 64 | int(q)) for s, t, a, b, (p, q) in zip(scale[inner], turn[inner], y[inner], x[inner], d[inner].tolist())})
        face = int(images.face(owner, scale, turn, y, x, d, 1)[0])
        found[k] = (face, corners, int(inner.sum()), len(owner))
    ids = sorted(found)
    links = {k: set() for k in ids}
    for a in ids:
        for b in ids:
            if a != b and min(found[a][3], found[b][3]) >= 2 and found[a][0] == found[b][0]:
                links[a].add(b)
            if found[a][0] <= found[b][0]:
                continue
            bins = {}
            for s1, t1, y1, x1, d1 in found[a][1]:
                for s2, t2, y2, x2, d2 in found[b][1]:
                    apart = d1 ^ d2
                    if apart.bit_count() > images.NEAR or all(apart >> k & 0xFFFFFFFF for k in (0, 32, 64, 96)):
                        continue
                    (m1, n1, u1, v1), (m2, n2, u2, v2) = sorted([(s1, t1, y1, x1), (s2, t2, y2, x2)], key=lambda c: -c[0]) if s1 < s2 else [(s1, t1, y1, x1), (s2, t2, y2, x2)]
                    angle = (n1 - n2) % images.TURNS
                    sin, cos = images.SINES[angle], images.COSINES[angle]
                    dy, dx = u1 - (1 + m1 - m2) * (v2 * sin + u2 * cos), v1 - (1 + m1 - m2) * (v2 * cos - u2 * sin)
                    place = (s1 - s2, (t1 - t2) % images.TURNS, int(np.floor(dy / 4)), int(np.floor(dx / 4)))
                    bins[place] = bins.get(place, 0) + 1
            votes = max((sum(bins.get((s, t, y + i, x + j), 0) for i in (0, 1) for j in (0, 1)) for s, t, p, q in list(bins) for y in (p, p - 1) for x in (q, q - 1)), default=0)
            least = min(found[a][2], found[b][2])
            if votes >= max(2, min(least, max(images.VOTES, int(np.ceil(least * images.SHARE))))):
                links[a].add(b)
                links[b].add(a)
    out = {}
    for k in ids:
        seen, todo = {k}, [k]
        while todo:
            for other in links[todo.pop()] - seen:
                seen.add(other)
                todo.append(other)
        out[k] = (min(seen), len(links[k]))
    return out


def patchwork(seed, n=14):
    """Images that share patches with each other, some of them copies, some only partly alike."""
    rng = np.random.default_rng(seed)
    parts = [scene(1000 * seed + k, 60, 64) for k in range(24)]
    ims = [np.vstack([parts[i] for i in rng.integers(0, 24, rng.integers(1, 4))]) for _ in range(n)]
    ims += [np.ascontiguousarray(np.rot90(ims[0])), ims[1][7:, 3:], ims[2], np.clip(ims[3].astype(int) + rng.integers(-2, 3, ims[3].shape), 0, 255).astype(np.uint8)]
    return [(10 + k, pgm(im)) for k, im in enumerate(ims)]


def test_groups_and_links_against_all_pairs_of_corners(spark):
    for seed in (1, 2, 3):
        rows = patchwork(seed)
        want = brute(rows)
        assert len({c for c, _ in want.values()}) > 1 and max(n for _, n in want.values()) > 1
        assert {r.id: (r.component_id, r.n_links) for r in groups(spark, rows, count_links=True)} == want
        assert {r.id: r.component_id for r in groups(spark, rows)} == {k: c for k, (c, _) in want.items()}


def test_query_against_all_pairs_of_corners(spark, sf_dir):
    """The query's groups of the longest texts, which have the most corners."""
    from vectriage.llm.queries import QUERIES

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    some = sorted((r for r in docs), key=lambda r: -len(r.text or ""))[:70]
    df = spark.createDataFrame([(r.doc_id, r.text) for r in some], "doc_id long, text string")
    rows = [(r.doc_id, bytes(r.image)) for r in df.select("doc_id", images.text_as_image(F.col("text")).alias("image")).collect()]
    want = {k: c for k, (c, _) in brute(rows).items()}
    assert {r.id: r.component_id for r in groups(spark, rows)} == want
    assert QUERIES["op8_image_copies"](spark, sf_dir).columns == ["doc_id", "n_points", "component_id", "kept"]


def textured(seed, h=320, w=400):
    """Smooth noise of several sizes, as photographs have it."""
    rng = np.random.default_rng(seed)
    out = np.zeros((h, w))
    for step in (64, 32, 16, 8, 4):
        g = rng.normal(size=(h // step + 2, w // step + 2))
        y, x = np.arange(h) / step, np.arange(w) / step
        i, j, a, b = y.astype(int), x.astype(int), (y % 1)[:, None], (x % 1)[None]
        out += step**0.5 * ((1 - a) * (1 - b) * g[i][:, j] + a * (1 - b) * g[i + 1][:, j] + (1 - a) * b * g[i][:, j + 1] + a * b * g[i + 1][:, j + 1])
    return ((out - out.min()) / (out.max() - out.min()) * 255).astype(np.uint8)


def test_recall_of_edited_copies(spark):
    """Of each kind of edit, nine in ten copies or more are found, and no two scenes are taken for one."""
    rng = np.random.default_rng(8)
    half = lambda im: (im.astype(int)[::2, ::2] + im[1::2, ::2] + im[::2, 1::2] + im[1::2, 1::2] >> 2).astype(np.uint8)
    edits = {
        "cropped": lambda im: im[40:280, 50:350],
        "cropped at odd places": lambda im: im[33:291, 47:333],
        "turned by 90": np.rot90,
        "turned by 180": lambda im: np.rot90(im, 2),
        "half size": half,
        "double size": lambda im: np.repeat(np.repeat(im, 2, 0), 2, 1),
        "noisy": lambda im: np.clip(im.astype(int) + rng.integers(-4, 5, im.shape), 0, 255).astype(np.uint8),
        "brighter": lambda im: np.clip(im.astype(int) + 20, 0, 255).astype(np.uint8),
        "painted over": lambda im: np.where(np.add.outer(np.arange(320) // 90, np.arange(400) // 90) % 4 == 0, 90, im).astype(np.uint8),
    }
    rows, kinds = [], {}
    for s in range(10):
        im = textured(60 + s)
        rows.append((100 * s, pgm(im)))
        for k, (name, edit) in enumerate(edits.items()):
            kinds[100 * s + k + 1] = name
            rows.append((100 * s + k + 1, pgm(np.ascontiguousarray(edit(im)))))
    found = {r.id: r.component_id for r in groups(spark, rows)}
    recall = {name: np.mean([found[k] == k // 100 * 100 for k, n in kinds.items() if n == name]) for name in edits}
    print(recall)
    assert min(recall.values()) >= 0.9
    assert all(c // 100 == k // 100 for k, c in found.items())


def test_long_images_other_columns_and_no_rows(spark):
    tall = np.vstack([scene(k, 400, 64) for k in range(30)])
    rows = [(1, bytearray(pgm(tall)), "a", 5), (2, bytearray(pgm(tall[900:4000])), "b", 6), (3, None, None, None)]
    df = spark.createDataFrame(rows, "id long, image binary, doc string, n_points int")
    out = images.find_copies(df, "id", "image")
    assert out.columns == ["id", "n_points", "component_id", "kept"] and {r.id: r.component_id for r in out.collect()} == {1: 1, 2: 1, 3: 3}
    assert images.find_copies(df.limit(0), "id", "image", count_links=True).count() == 0


def test_crops_and_edits_are_found(spark):
    rng = np.random.default_rng(3)
    rows = []
    for s in range(6):
        im = scene(s)
        edited = im.copy()
        edited[100:130, 40:90] = rng.integers(0, 255)
        brighter = np.clip(im.astype(int) + 12, 0, 255).astype(np.uint8)
        rows += [(10 * s + 1, pgm(im)), (10 * s + 2, pgm(im[24:150, 30:190])), (10 * s + 3, pgm(edited)), (10 * s + 4, pgm(brighter)), (10 * s + 5, pgm(im))]
    found = {r.id: r.component_id for r in groups(spark, rows)}
    assert found == {k: k // 10 * 10 + 1 for k, _ in rows}


def test_defined_results(spark):
    im = scene(1)
    rows = [(1, None), (2, b""), (3, b"P5\n5 5\n255\nxx"), (4, b"GIF"), (5, pgm(np.zeros((40, 40), np.uint8))), (6, pgm(im)), (6, pgm(im)), (None, pgm(im)), (7, pgm(im[:1, :1])), (8, pgm(scene(2)))]
    found = [(r.id, r.component_id, r.kept) for r in groups(spark, rows)]
    assert len(found) == 10 and all(c == i for i, c, _ in found) and all(k for _, _, k in found)
    assert groups(spark, []) == []


def test_descriptors_don_t_depend_on_neighbours():
    ims = [scene(k, 60 + 3 * k, 64) for k in range(8)]
    whole = images.describe(ims)
    for i, im in enumerate(ims):
        alone = images.describe([im])
        own = whole[0] == i
        assert (np.sort(whole[5][own], 0) == np.sort(alone[5], 0)).all() and sorted(zip(whole[3][own], whole[4][own])) == sorted(zip(alone[3], alone[4]))


def test_matches_against_all_pairs_of_equal_descriptors():
    rng = np.random.default_rng(2)
    d = rng.integers(0, 2**63, (12, 2)).astype(np.uint64)[rng.integers(0, 12, 60)]
    doc = rng.integers(0, 9, 60)
    chunk = np.zeros(60, np.int64)
    zero = np.zeros(60, np.int64)
    votes = images.match((d[:, 0] >> np.uint64(32)), doc, zero, zero, zero, zero, d, chunk)
    linked = {tuple(v[:2]) for v in votes.tolist()}
    for k in range(60):
        own = sorted(set(doc[(d == d[k]).all(1)].tolist()))
        assert all((b, own[0]) in linked for b in own[1:])


def test_query(spark, sf_dir):
    from vectriage.llm.queries import QUERIES

    got = {r.doc_id: r.component_id for r in QUERIES["op8_image_copies"](spark, sf_dir).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert got.keys() == docs.keys() and all(c <= d for d, c in got.items())
    first = {}
    for d in sorted(docs):
        if len(docs[d]) > 1500:
            assert got[d] == got[first.setdefault(docs[d], d)]


def bits(*flips):
    """A descriptor with some bits flipped; bits 0 to 31 are the first table's, and so on."""
    value = 0x0123456789ABCDEF_FEDCBA9876543210
    for k in flips:
        value ^= 1 << (127 - k)
    return [value >> 64, value & (1 << 64) - 1]


def votes_of(rows):
    """Votes among corners (doc, y, x, descriptor), through all four tables."""
    d = np.repeat(np.array([r[3] for r in rows], np.uint64), 4, axis=0)
    chunk = np.tile(np.arange(4), len(rows))
    doc, y, x = (np.repeat(np.array([r[k] for r in rows], np.int64), 4) for k in range(3))
    half = d[np.arange(len(d)), chunk // 2]
    value = np.where(chunk % 2 == 0, half >> np.uint64(32), half & np.uint64(0xFFFFFFFF))
    one = np.ones(len(d), np.int64)
    return images.match(value + (chunk.astype(np.uint64) << np.uint64(32)), doc, one, one, y, x, d, chunk).tolist()


def test_a_bucket_compares_all_its_descriptors():
    far = list(range(32, 128, 3))  # doc 1 shares the first chunk only
    rows = [(1, 0, 0, bits(*far)), (2, 0, 0, bits(40)), (3, 0, 0, bits(70, 100))]
    assert [(v[0], v[1], v[3]) for v in votes_of(rows)] == [(3, 2, 1)]
    shared = [(k, 5 * k, 0, bits()) for k in range(1, 6)]
    assert {(v[0], v[1]) for v in votes_of(shared)} == {(a, b) for a in range(1, 6) for b in range(1, a)}
    many = [(k, 0, 0, bits(*np.random.default_rng(k).choice(np.arange(32, 128), 12, replace=False).tolist())) for k in range(90)]
    want = {(a, b) for a in range(90) for b in range(a) if sum((p ^ q).bit_count() for p, q in zip(many[a][3], many[b][3])) <= images.NEAR}
    assert want and {(v[0], v[1]) for v in votes_of(many)} == want


def test_a_pair_counts_although_others_share_its_first_table():
    far = list(range(32, 128, 3))  # doc 1 shares the first chunk only; docs 2 and 3 differ in the second
    rows = [(1, 0, 0, bits(*far)), (2, 0, 0, bits()), (3, 0, 0, bits(34, 41, 50, 60))]
    assert [(v[0], v[1], v[3]) for v in votes_of(rows)] == [(3, 2, 1)]
    rng = np.random.default_rng(5)
    rows = [(k, 0, 0, bits(*rng.choice(128, rng.integers(0, 7), replace=False).tolist())) for k in range(40)]
    meet = lambda p, q: any((p[k // 2] ^ q[k // 2]) >> (32 if k % 2 == 0 else 0) & 0xFFFFFFFF == 0 for k in range(4))
    want = {(a, b): 1 for a in range(40) for b in range(a) if meet(rows[a][3], rows[b][3])}
    assert {(v[0], v[1]): v[3] for v in votes_of(rows)} == want


def test_each_pair_of_corners_votes_once():
    assert [v[3] for v in votes_of([(1, 0, 0, bits()), (2, 0, 0, bits())])] == [1]
    rows = [(k, y, 0, bits(*f)) for k in (1, 2) for y, f in ((0, [1, 40, 70, 100]), (50, [2, 3, 45, 77, 111]), (99, [9, 39, 85, 125]))]
    assert max(v[3] for v in votes_of(rows) if v[0] != v[1]) == 3


def test_turned_and_resized_copies_are_found(spark):
    rows = []
    for s in range(4):
        im = scene(20 + s, 320, 400)
        half = (im.astype(int)[::2, ::2] + im[1::2, ::2] + im[::2, 1::2] + im[1::2, 1::2] >> 2).astype(np.uint8)
        edited = np.rot90(im)[30:370, 20:300].copy()
        edited[100:140, 60:120] = 7
        copies = [im, np.rot90(im), np.rot90(im, 2), np.rot90(im, 3), half, np.rot90(half), edited, half[10:150, 14:190]]
        rows += [(10 * s + k + 1, pgm(np.ascontiguousarray(c))) for k, c in enumerate(copies)]
    found = {r.id: r.component_id for r in groups(spark, rows)}
    assert found == {k: k // 10 * 10 + 1 for k, _ in rows}
