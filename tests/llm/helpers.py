"""Small tables with every odd case: nulls, empty and long texts, ties, repeats, clashing names."""

import random

CLASH = "id string, fp string, size string, kept string, block string, shard string, component_id string, source string, lang string, n_chars long, item string, mention string"


def prose(seed, words, vocabulary=400):
    rng = random.Random(seed)
    names = [f"{rng.choice('bcdfglmnprst')}{rng.choice('aeiou')}{rng.choice('bcdfglmnprst')}{i}x" for i in range(vocabulary)]
    names = ["".join(c for c in n if c.isalpha()) + "é" * (i % 3 == 0) for i, n in enumerate(names)]
    return " ".join(rng.choice(names) for _ in range(words))


def cases():
    base = prose(1, 120)
    return [
        (10, base), (11, base), (11, base), (12, base.upper()), (13, base.replace(" ", "  \n", 3)), (20, prose(2, 90)), (20, prose(3, 90)),
        (30, None), (31, ""), (32, " \t\n "), (33, "one two"), (None, prose(4, 80)), (None, None), (40, prose(5, 15_000)), (41, "é▁ <|endoftext|> <s>  x\x00y. don't"),
        (50, "same\nsame\n" + prose(6, 70) + "\n" + base[:80]), (51, base[:80] + "\nother line here"),
    ]


def table(spark, rows):
    wide = [(i, t, "id", "fp", "size", "kept", "block", "shard", "c", "src", "en", len(t or ""), "item", "mention") for i, t in rows]
    return spark.createDataFrame(wide, f"doc_id long, text string, {CLASH}")


def empty(spark):
    return table(spark, cases()).limit(0)
