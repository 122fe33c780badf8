import random
from collections import defaultdict

import pytest

from cuemill.operators import regions


def first_fit(items, fits):
    groups = []
    for item in items:
        home = next((g for g in groups if fits(g, item)), None)
        home.append(item) if home is not None else groups.append([item])
    return groups


def envelope(g):
    """x, y, width, height, text, mean confidence."""
    left, top, right, bottom = min(b[0] for b in g), min(b[1] for b in g), max(b[0] + b[2] for b in g), max(b[1] + b[3] for b in g)
    return left, top, right - left, bottom - top, " ".join(b[4] for b in g), sum(b[5] for b in g) / len(g)


def by_frame(rows):
    out = defaultdict(list)
    for video, frame, *box in rows:
        out[video, frame].append(tuple(box))
    return out


def plain_lines(rows):
    def fits(g, b):
        return abs(b[1] + b[3] / 2 - sum(v[1] + v[3] / 2 for v in g) / len(g)) <= 2.5 and b[0] - max(v[0] + v[2] for v in g) <= 8

    return [(*k, *envelope(g)) for k, boxes in by_frame(rows).items() for g in first_fit(sorted(boxes, key=lambda b: (b[0], b[1], b[4], b[5])), fits)]


def plain_blocks(rows):
    def fits(g, b):
        x, y, w, h, *_ = envelope(g)
        gap = max(0.0, b[1] - (y + h), y - (b[1] + b[3]))
        return gap <= 2.5 and abs(b[0] + b[2] / 2 - (2 * x + w) / 2) <= 22 and max(y + h, b[1] + b[3]) - min(y, b[1]) <= 20

    return [(*k, *envelope(g)) for k, boxes in by_frame(rows).items() for g in first_fit(sorted(boxes, key=lambda b: (b[1], b[0], b[4], b[5])), fits)]


def rounded(rows):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)


@pytest.mark.parametrize("seed", range(2))
def test_lines_blocks_and_clusters_equal_first_fit(spark, seed):
    rng = random.Random(seed)
    step = lambda low, high: rng.randrange(low * 8, high * 8) / 8  # noqa: E731  # eighths are exact
    rows = [(rng.choice("ab"), rng.randrange(6), step(0, 80), step(0, 90), step(4, 30), step(1, 8), f"word{i}", rng.choice([0.75, 0.875, 1.0])) for i in range(400)]
    frame = spark.createDataFrame(rows, regions.BOX)
    found = regions.lines(frame)
    want = plain_lines(rows)
    assert rounded(map(tuple, found.collect())) == rounded(want)
    blocks = regions.blocks(spark.createDataFrame(want, regions.BOX))
    made = plain_blocks(want)
    assert rounded(map(tuple, blocks.collect())) == rounded(made)
    usable = [b for b in made if b[7] >= 0.68 and 12 <= b[4] <= 82 and 1 <= b[5] <= 20 and 25 <= b[2] + b[4] / 2 <= 75 and b[3] + b[5] <= 100]
    usable += [(v, f + 10, *rest) for v, f, *rest in usable]  # the same places on other frames
    members = defaultdict(list)
    for r in regions.clusters(spark.createDataFrame(usable, regions.BOX)).collect():
        members[r["video_id"], tuple(r["cluster"])].append((r["frame"], r["x"], r["y"], r["text"]))
    for video in "ab":
        mine = sorted((b for b in usable if b[0] == video), key=lambda b: (b[3], b[2], b[1], b[6]))
        near = lambda g, b: abs(b[2] + b[4] / 2 - g[0][2] - g[0][4] / 2) <= 10 and abs(b[3] + b[5] / 2 - g[0][3] - g[0][5] / 2) <= 6
        groups = [sorted((b[1], b[2], b[3], b[6]) for b in g) for g in first_fit(mine, near)]
        assert sorted(sorted(m) for (v, _), m in members.items() if v == video) == sorted(groups)


def test_no_python_in_the_plan(spark):
    plan = regions.caption_regions(spark.createDataFrame([], regions.BOX))
    assert plan.collect() == [] and not any(n in plan._jdf.queryExecution().toString() for n in ("Pandas", "InArrow", "EvalPython"))
