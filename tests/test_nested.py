"""Free-form JSON at any depth against plain recursive functions."""

import json
import random
import re

from pyspark.sql import functions as F

from tessera.functions import nested, text

PARTS, ENDS = nested.SENSITIVE_KEYS, nested.SENSITIVE_ENDS


def bad_key(key):
    k = key.lower().replace("-", "_")
    return k in PARTS or k.endswith(tuple(ENDS)) or any(k.startswith(p + "_") for p in PARTS)


def bad_text(value):
    return bool(re.search(text.SENSITIVE, value))


def stay(value, key=None, depth=0):
    if isinstance(value, str):
        return [] if bad_text(value) else [value if key in text.IDENTITY else value[:512]]
    if not isinstance(value, list | dict):
        return [value]
    if depth == 4:
        return []
    if isinstance(value, list):
        return [[x for v in value[:64] for x in stay(v, None, depth + 1)]]
    pairs = [(k[:128], x) for k, v in value.items() if not bad_key(k[:128]) for x in stay(v, k[:128], depth + 1)]
    return [dict(sorted(pairs, key=lambda p: (p[0] not in text.IDENTITY, p[0].encode()))[:64])]


def strings(value):
    if isinstance(value, str):
        yield value
    for v in value.values() if isinstance(value, dict) else value if isinstance(value, list) else []:
        yield from strings(v)


def keys(value):
    for k, v in value.items() if isinstance(value, dict) else ():
        yield k
        yield from keys(v)
    for v in value if isinstance(value, list) else []:
        yield from keys(v)


def rewritten(value, new):
    if isinstance(value, dict):
        return {k: new[k] if k in new and not isinstance(v, list | dict) else rewritten(v, new) for k, v in value.items()}
    return [rewritten(v, new) for v in value] if isinstance(value, list) else value


def made(rng, depth=0):
    words = ["a", "plain text", "my password", "token = 1", "/etc/x", "C:\\y", 'quote " and: colon', '{"k": "v"}', "é\n\t\\", "x" * 600, "", "back\\", '":', "variant"]
    names = ["a", "b_ref", "image_path", "Token", "token_x", "tokens", "credential-a", "url", "variant_id", "block_id", "set_shape", "add_image", "shape", "export_id", "created_at", "k" * 200, 'q"k', "é:", "remove_add_x"]
    kind = rng.random()
    if depth < 7 and kind < 0.35:
        return {rng.choice(names): made(rng, depth + 1) for _ in range(rng.randrange(6))}
    if depth < 7 and kind < 0.6:
        return [made(rng, depth + 1) for _ in range(rng.randrange(5))]
    return rng.choice([rng.choice(words), rng.choice(words), rng.randrange(-5, 10**12), 1.5, True, False, None])


def test_against_plain_recursion(spark):
    rng = random.Random(5)
    values = [made(rng) for _ in range(400)] + [{f"k{i:03}": i for i in range(90)} | {"variant_id": "y" * 700, "tile_id": "t"}, list(range(90)), {}, [], "secret", "fine", 3, None]
    values = [v if not isinstance(v, str) or v else "x" for v in values]
    rows = spark.createDataFrame([(i, json.dumps(v, ensure_ascii=i % 2 == 0, indent=i % 3 or None)) for i, v in enumerate(values)], "i int, j string")
    new = {"export_id": 'n$1 "\\', "created_at": "now"}
    got = rows.select("i", nested.redact_json(F.col("j")).alias("kept"), nested.json_strings(F.col("j")).alias("strings"), nested.json_keys(F.col("j")).alias("keys"), nested.sensitive_json(F.col("j")).alias("bad"),
                      nested.forbidden_keys(F.col("j")).alias("forbidden"), nested.rewrite_json(F.col("j"), {k: F.lit(v) for k, v in new.items()}).alias("rewritten")).collect()
    plain = lambda k: re.sub("^(?:set_)?(?:add_)?(?:remove_)?", "", k)
    for r in got:
        value = values[r["i"]]
        want = stay(value)
        assert (r["kept"] is None) == (not want), value
        if want:
            assert json.loads(r["kept"]) == want[0] and (not isinstance(want[0], dict) or list(json.loads(r["kept"])) == list(want[0]))
        assert sorted(r["strings"]) == sorted(strings(value)) and sorted(r["keys"]) == sorted(keys(value))
        assert r["bad"] == any(map(bad_text, strings(value)))
        fields = {k if k in nested.MACHINE_FIELDS else plain(k) for k in keys(value)} & set(nested.MACHINE_FIELDS)
        assert set(r["forbidden"]) == fields and len(r["forbidden"]) == len(fields)
        assert json.loads(r["rewritten"]) == rewritten(value, new)


def test_what_is_no_json(spark):
    rows = spark.createDataFrame([(None,), ("",), ("{",), ("my password",), ('{"a":1,"a":2}',), ("NaN",)], "j string")
    got = rows.select(nested.redact_json(F.col("j")).alias("kept"), nested.sensitive_json(F.col("j")).alias("bad"), nested.json_keys(F.col("j")).alias("keys")).collect()
    assert [r["kept"] for r in got] == [None] * 6 and [r["bad"] for r in got] == [False, False, False, True, False, False] and not any(r["keys"] for r in got)


def test_long_strings_and_deep_values(spark):
    deep = "[" * 60 + '{"set_shape":"password"}' + "]" * 60
    long = json.dumps({"a": "y\\\n" * 100_000, "b": ["z"] * 1000})
    got = spark.createDataFrame([(deep,), (long,)], "j string").select(nested.sensitive_json(F.col("j")).alias("bad"), nested.forbidden_keys(F.col("j")).alias("f"), F.length(nested.redact_json(F.col("j"))).alias("n")).collect()
    assert [r["bad"] for r in got] == [True, False] and got[0]["f"] == ["shape"] and got[0]["n"] == 8 and got[1]["n"] < 1500
