"""Effects of unknown junctions on exons, on fixtures of both strands' sides and against a plain version."""

import random

from junctura.operators import exonchain

RANGE = "seqname string, start long, end long, strand string"


def frames(spark, junctions, introns, exons):
    return (
        spark.createDataFrame([(i, "c", a, b, "+", k) for i, (a, b, k) in junctions.items()], f"junction_id long, {RANGE}, annotated string"),
        spark.createDataFrame([("c", a, b, "+", float(m)) for a, b, m in introns], f"{RANGE}, median_count double"),
        spark.createDataFrame([("c", a, b, "+") for a, b in exons], RANGE),
    )


def plain_side(j, far, introns, exons, left):
    """Effect and shift at one end, in mirrored coordinates for the left one."""
    turn = (lambda x: [(-b, -a, *m) for a, b, *m in x]) if left else (lambda x: [(a, b, *m) for a, b, *m in x])
    introns, exons = turn(introns), turn(exons)
    start, end = (-j[1], -j[0]) if left else j
    far = -far if left else far
    if far > end:
        return "exonElongation", far - end
    following = sorted({b for a, b in exons if a == far + 1})
    if far < end and following:
        if following[-1] > end:
            return "exonTruncation", -(end - far)
        if len(following) == 1 and following[0] < end:
            stop = following[0]
            behind = [(m, -b) for a, b, m in introns if a == stop + 1]
            if not any(start <= a and b <= far for a, b in exons) and behind:
                _, nxt = max(behind)
                nxt = -nxt
                if end <= nxt and not any(stop + 1 <= a and b <= nxt for a, b in exons):
                    return "singleExonSkipping", -(stop - far) + nxt - end
    return "exonSkipping", 0


def plain(junctions, introns, exons):
    out = {}
    for i, (a, b, k) in junctions.items():
        near = [x for x in introns if {"start": x[0] == a, "end": x[1] == b, "none": x[0] <= b and a <= x[1]}[k]]
        if not near:
            out[i] = ("noOverlap", "inconclusive")
            continue
        top = min(near, key=lambda x: (-x[2], x[0], x[1]))
        sides = [plain_side((a, b), top[1], introns, exons, False)] if k != "end" else []
        sides += [plain_side((a, b), top[0], introns, exons, True)] if k != "start" else []
        kinds, total = [s[0] for s in sides], sum(s[1] for s in sides)
        frame = "unlikely" if total % 3 == 0 else "likely"
        if len(sides) == 1:
            out[i] = (kinds[0], "inconclusive" if kinds[0] == "exonSkipping" else frame)
        elif "exonSkipping" in kinds or kinds == ["singleExonSkipping"] * 2:
            out[i] = ("exonSkipping", "inconclusive")
        elif "singleExonSkipping" in kinds:
            out[i] = ("singleExonSkipping", frame)
        else:
            out[i] = (kinds[0] if kinds[0] == kinds[1] else "exonTruncation&Elongation", frame)
    return out


def test_effects_by_hand(spark):
    exons = [(100, 199), (301, 400), (501, 600), (701, 800)]
    introns = [(200, 300, 9), (401, 500, 9), (601, 700, 9)]
    junctions = {
        1: (200, 290, "start"), 2: (200, 291, "start"), 3: (200, 330, "start"), 4: (200, 333, "start"), 5: (200, 500, "start"), 6: (200, 480, "start"), 7: (200, 700, "start"),
        8: (210, 300, "end"), 9: (170, 300, "end"), 10: (200, 500, "end"), 11: (205, 305, "none"), 12: (190, 310, "none"), 13: (206, 297, "none"), 14: (190, 480, "none"), 15: (900, 950, "none"),
    }
    got = {r.junction_id: (r.effect, r.frameshift) for r in exonchain.chain_impact(*frames(spark, junctions, introns, exons)).collect()}
    assert got == plain(junctions, introns, exons)
    assert got[1] == ("exonElongation", "likely") and got[2] == ("exonElongation", "unlikely") and got[3] == ("exonTruncation", "unlikely") and got[4] == ("exonTruncation", "unlikely") and got[5] == ("singleExonSkipping", "likely")
    assert got[7] == ("exonSkipping", "inconclusive") and got[11] == ("exonTruncation&Elongation", "unlikely") and got[15] == ("noOverlap", "inconclusive") and got[10][0] == "singleExonSkipping"


def test_effects_of_random_chains(spark):
    rng = random.Random(4)
    exons, at = [], 50
    for _ in range(25):
        size = rng.randint(3, 30)
        exons.append((at, at + size))
        at += size + rng.randint(10, 60)
    introns = [(exons[i][1] + 1, exons[k][0] - 1, rng.randint(1, 9)) for i in range(24) for k in (i + 1, i + 2) if k < 25]
    exons += [(a, b + 7) for a, b in exons[::6]]
    edges = sorted({x for i in introns for x in i[:2]})
    junctions = {}
    for n in range(400):
        a, b = sorted((rng.choice(edges) + rng.choice([0, 0, 3, -4]), rng.choice(edges) + rng.choice([0, 0, 5, -3])))
        kinds = [k for k, ok in (("start", any(x[0] == a for x in introns)), ("end", any(x[1] == b for x in introns)), ("none", True)) if ok]
        junctions[n] = (a, b, rng.choice(kinds))
    got = {r.junction_id: (r.effect, r.frameshift) for r in exonchain.chain_impact(*frames(spark, junctions, introns, exons)).collect()}
    assert got == plain(junctions, introns, exons) and len({e for e, _ in got.values()}) >= 5
