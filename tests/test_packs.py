"""Packs against a plain version that walks the items one by one."""

import collections
import random

from notelake.operators import packs

FIELDS = "scope_id string, concept_id string, category string, priority int, binding boolean, required boolean, stale boolean, characters bigint, title string, path string, description string"


def plain(items, limit, most, documents):
    ordered, seen, kept = sorted(items, key=lambda x: (x["priority"], x["concept_id"])), collections.Counter(), []
    for x in ordered:
        if x["binding"]:
            kept.append(x)
        elif x["required"] or seen[x["category"]] < packs.CAPS.get(x["category"], 1 << 30):
            seen[x["category"]] += 1
            kept.append(x)
    free = [x for x in kept if not x["binding"] and not x["required"]][:most]
    kept = [x for x in kept if x["binding"] or x["required"] or x in free]
    # The rule: an index line is a title and 110, a required one its path and 90 more, a description 16 and itself;
    # bodies get the budget, or what a response of 24,000 less a frame of 5,000 leaves.
    index = sum(len(x["title"]) + 110 + (len(x["path"]) + 90 if x["required"] else 0) + (len(x["description"]) + 16 if x["description"] else 0) for x in kept)
    room = max(0, min(limit, 24_000 - 5_000 - index))
    made, spent, bodies = {}, 0, 0
    for place, x in sorted(enumerate(kept, 1), key=lambda p: (not p[1]["required"], not p[1]["binding"], p[1]["stale"], p[0])):
        if x["characters"] is None:
            made[x["concept_id"]] = (place, False, None)
            continue
        reason = "larger than budget" if x["characters"] > room else "document limit" if bodies >= documents else "budget spent" if spent + x["characters"] > room else None
        if reason is None:
            spent, bodies = spent + x["characters"], bodies + 1
        made[x["concept_id"]] = (place, reason is None, reason)
    return made


def test_budget_equals_the_plain_walk(spark):
    rng, rows = random.Random(2), []
    for s in range(12):
        for i in range(rng.randrange(1, 120)):
            category = rng.choice([*packs.CAPS, "other"])
            rows.append((f"s{s}", f"c{i:03}", category, rng.choice((50, 100, 300)), rng.random() < 0.2, rng.random() < 0.1, rng.random() < 0.3, rng.choice((None, *[rng.randrange(6000)] * 9)), "t" * rng.randrange(30), "p" * rng.randrange(9), rng.choice((None, "", "d" * rng.randrange(50)))))
    items = spark.createDataFrame(rows, FIELDS)
    for limit, most, documents in ((16_000, 40, 40), (60_000, 10, 5), (3_000, 4, 4)):
        made = collections.defaultdict(dict)
        for r in packs.apply_budget(items, limit, most, documents).collect():
            made[r.scope_id][r.concept_id] = (r.place, r.full, r.reason)
        for s in range(12):
            assert made[f"s{s}"] == plain([dict(zip(items.columns, r, strict=True)) for r in rows if r[0] == f"s{s}"], limit, most, documents)
