"""Override files: blocks, values and the file written anew, against a plain version on the parsed object."""

import json
import random

from tidelane.operators import coords, override_file

NAMES = {v: k for k, v in override_file.BLOCKS.items()}


def made(seed: int, with_seeded=True, seeded_last=True):
    """A file's object, and the block of each of its keys."""
    rng, out, block_of = random.Random(seed), {"_format": 'Keys that begin with "_" are remarks: "12": x', "_source_url_csv": "u", "_block_suppressed": "s", "_suppress_index_nos": [7, 8]}, {}
    keys = [str(k) for k in rng.sample(range(100, 999), 80)]
    blocks = ["manual", "csv_wrong", "us"] + (["iwls"] if with_seeded else [])
    if not seeded_last:
        blocks = ["iwls", "us", "manual"]
    for key in keys[:5]:
        out[key], block_of[key] = None, "manual"
    for i, block in enumerate(blocks):
        out[NAMES[block]] = f"of {block}, 8°"
        for key in keys[5 + 15 * i : 20 + 15 * i]:
            out[key], block_of[key] = rng.choice([None, [-123.5, 48.25], [round(rng.uniform(-130, -120), 6), round(rng.uniform(45, 50), 6)]]) if block != "iwls" else [round(rng.uniform(-130, -120), 2), round(rng.uniform(45, 50), 6)], block
        out["_note" + block] = "inside"
    return out, block_of, keys


def lines_of(spark, texts: dict[str, str]):
    return spark.createDataFrame([(f, i, t) for f, text in texts.items() for i, t in enumerate(text.rstrip("\n").split("\n"))], "file string, line int, text string").repartition(3)


def dumped(x) -> str:
    return json.dumps(x, indent=2, ensure_ascii=False) + "\n"


def test_blocks_and_values(spark):
    texts, want = {}, []
    for seed in range(3):
        x, block_of, _ = made(seed, seeded_last=seed != 1)
        texts[f"f{seed}"] = dumped(x)
        want += [(f"f{seed}", int(k), *((x[k] or [None, None])[::-1]), b) for k, b in block_of.items()]
    got = sorted(map(tuple, override_file.current(lines_of(spark, texts)).collect()), key=repr)
    assert got == sorted(want, key=repr)
    assert {b for *_, b in want} == {"manual", "csv_wrong", "us", "iwls"}


def plain_sync(x, block_of, roster, upstream, remark):
    """The object after a re-seeding: seeded entries at the end of their block, in order of number."""
    final = {}
    for key, block in block_of.items():
        if block == "iwls" and int(key) in roster and int(key) in upstream:
            final[int(key)] = upstream[int(key)]
    for n in roster:
        if n in upstream and str(n) not in block_of:
            final[n] = upstream[n]
    rest = [(k, v) for k, v in x.items() if block_of.get(k) != "iwls"]
    names = [k for k, _ in rest]
    entries = [(str(n), final[n]) for n in sorted(final)]
    if NAMES["iwls"] not in names:
        return dict(rest + [(NAMES["iwls"], remark)] + entries)
    start = names.index(NAMES["iwls"])
    after = [i for i in range(start + 1, len(names)) if names[i].startswith("_block_")]
    stop = after[0] if after else len(names)
    rest[start] = (NAMES["iwls"], remark)
    return dict(rest[:stop] + entries + rest[stop:])


def test_from_text_to_text(spark):
    remark = 'seeded from "upstream" — do not edit'
    for seed, with_seeded, seeded_last in ((1, True, True), (2, True, False), (3, False, True)):
        x, block_of, keys = made(seed, with_seeded, seeded_last)
        rng = random.Random(seed)
        roster = {int(k) for k in rng.sample(keys, 60)}
        upstream = {int(k): [round(rng.uniform(-130, -120), 6), round(rng.uniform(45, 50), 6)] for k in rng.sample(keys, 55)}
        for k in [k for k, b in block_of.items() if b == "iwls"][:5]:
            roster.add(int(k))
            upstream[int(k)] = x[k]
        lines = lines_of(spark, {"f": dumped(x)})
        synced = coords.sync(
            spark.createDataFrame([(n, 1.0, 2.0) for n in roster], "index_no int, lat double, lon double"), spark.createDataFrame([(n, v[1], v[0]) for n, v in upstream.items()], "index_no int, lat double, lon double"),
            override_file.current(lines).drop("file"),
        )
        got = "\n".join(r.text for r in override_file.rewritten(lines, synced, remark).orderBy("line").collect()) + "\n"
        assert got == dumped(plain_sync(x, block_of, roster, upstream, remark))
        actions = {r.action for r in synced.collect()}
        assert "skipped_manual" in actions and "added" in actions and (not with_seeded or {"no_change", "removed_no_source"} <= actions)


def test_read_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n  "1": null\n}\n')
    got = override_file.read_lines(spark, f"file://{tmp_path}").orderBy("line").collect()
    assert [(r.line, r.text) for r in got] == [(0, "{"), (1, '  "1": null'), (2, "}")] and got[0].file.endswith("a.json")
