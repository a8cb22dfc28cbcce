"""Small regions merged by priority, against one part after another."""

import numpy as np
import pytest

from tessella.operators import contraction


def cells(spark, a):
    return spark.createDataFrame([("a", y, x, int(a[y, x])) for y in range(a.shape[0]) for x in range(a.shape[1])], "image_id string, y long, x long, label long")


def run(spark, a, minimum, **k):
    out = np.full(a.shape, -1)
    for r in contraction.fill_small_regions(cells(spark, a), "label", minimum, **k).collect():
        out[r.y, r.x] = r.label
    return out


def flood(a, inside):
    """Parts (8-connected, of one value) in the order of their first cells."""
    of, parts = np.zeros(a.shape, int), []
    for at in zip(*np.nonzero(inside), strict=True):
        if of[at]:
            continue
        todo, own = [at], []
        of[at] = len(parts) + 1
        while todo:
            y, x = todo.pop()
            own.append((y, x))
            for q in near(a, y, x):
                if inside[q] and not of[q] and a[q] == a[at]:
                    of[q] = len(parts) + 1
                    todo.append(q)
        parts.append(own)
    return of, parts


def near(a, y, x):
    return [(v, u) for v in range(max(0, y - 1), min(a.shape[0], y + 2)) for u in range(max(0, x - 1), min(a.shape[1], x + 2)) if (v, u) != (y, x)]


def plain(a, minimum):
    of, parts = flood(a, a > 0)
    size = {0: 0, **{k + 1: len(p) for k, p in enumerate(parts)}}
    start, touch, group = dict(size), {}, {k: k for k in size}
    for k, p in enumerate(parts):
        if len(p) < minimum:
            touch[k + 1] = [of[q] for q in {q for c in p for q in near(a, *c)} if of[q] != k + 1]
    for c in sorted(touch, key=lambda c: (-start[c], c)):
        if size[c] >= minimum:
            continue
        votes = [group[n] for n in touch[c] if group[n] not in (c, 0)]
        won = max(set(votes), key=lambda n: (votes.count(n), size[n], -n), default=0)
        size[won] += size[c]
        group = {k: won if g == c else g for k, g in group.items()}
        if won in touch:
            touch[won] = touch[won] + touch[c]
    label = {0: 0, **{k + 1: a[p[0]] for k, p in enumerate(parts)}}
    out = np.vectorize(lambda k: label[group[k]])(of)
    voids, holes = flood(a, a == 0)
    for p in holes:
        ring = sorted({q for c in p for q in near(a, *c) if voids[q] != voids[p[0]] and out[q] > 0})
        if len(p) < minimum and ring and all(0 < y < a.shape[0] - 1 and 0 < x < a.shape[1] - 1 for y, x in p):
            votes = [out[q] for q in ring]
            most = max(map(votes.count, votes))
            for q in p:
                out[q] = next(v for v in votes if votes.count(v) == most)
    return out


@pytest.mark.parametrize("seed,classes,minimum,most", [(1, 3, 4, 20_000), (2, 4, 7, 20_000), (3, 3, 5, 30), (4, 5, 9, 1)])
def test_equals_one_part_after_another(spark, seed, classes, minimum, most):
    """Noise, so that most parts are small and touch; groups in tasks, or large ones by rounds first."""
    a = np.random.default_rng(seed).integers(0, classes, (16, 18))
    assert (run(spark, a, minimum, block=8, most=most) == plain(a, minimum)).all()


def test_ties_ask_for_sizes_that_others_change(spark):
    """Two regions of nearly one size: earlier merges elsewhere decide which of them is larger."""
    a = np.zeros((9, 40), int)
    a[:, :20], a[:, 20:] = 1, 2
    a[0, 20:] = 0
    a[2, 36:39], a[4, 33:38], a[6, 30:38] = 3, 3, 3
    a[3:5, 19:21] = 4
    a[7, 3] = 5
    assert (run(spark, a, 9) == plain(a, 9)).all()


def test_an_area_of_the_minimum_stays(spark):
    a = np.ones((30, 30), int)
    a[5, 3:22], a[12, 3:23] = 2, 3
    out = run(spark, a, 20)
    assert (out[5, 3:22] == 1).all() and (out[12, 3:23] == 3).all() and (out != a).sum() == 19


def test_background_stays_and_surrounding_regions_win(spark):
    a = np.zeros((20, 20), int)
    a[2:18, 2:18], a[8:10, 8:10], a[4, 4] = 1, 2, 0
    out = run(spark, a, 20)
    assert (out[0] == 0).all() and out[4, 4] == 1 and (out[8:10, 8:10] == 1).all()


def test_names_of_labels_dont_matter(spark):
    a = np.ones((30, 30), int)
    a[:, 16:], a[12:14, 14:16] = 2, 3
    new = np.array([0, 7, 4, 9])
    assert (new[run(spark, a, 20)] == run(spark, new[a], 20)).all()


def test_holes_of_the_minimum_and_at_the_frame_stay(spark):
    a = np.ones((30, 40), int)
    a[5, 3:23], a[12, 3:22], a[0, 0] = 0, 0, 0
    out = run(spark, a, 20)
    assert (out[5, 3:23] == 0).all() and (out[12, 3:22] == 1).all() and out[0, 0] == 0


def test_lone_parts_and_nothing(spark):
    assert (run(spark, np.ones((2, 2), int), 20) == 0).all()
    assert contraction.fill_small_regions(cells(spark, np.ones((2, 2), int)).limit(0), "label").collect() == []
    with pytest.raises(ValueError):
        contraction.fill_small_regions(cells(spark, np.ones((2, 2), int)), "label", 0)
