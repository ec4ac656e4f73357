"""A small table with the awkward cases, and the plain word functions."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block int, kind string"


def words(text, lower=False):
    if text is None:
        return []
    if lower:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def rows(seed=7, n=120):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(300)] + ["Éa", "straße", "naïve x", "日本", "😀", "***", "a.b"]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    out = []
    for i in range(n):
        kind = i % 8
        size = rng.choice([1, 3, 4, 5, 8, 13, 30, 80, 200])
        text = rng.choice([" ", "\n", "\t \u000b"]).join(rng.choice(vocabulary) for _ in range(size))
        if kind == 1 and out:
            text = rng.choice(out)[1]
        elif kind == 2 and out:
            parts = words(rng.choice(out)[1])
            for _ in range(rng.choice([0, 1, 2, 4])):
                if parts:
                    parts[rng.randrange(len(parts))] = rng.choice(vocabulary)
            text = "  ".join(parts)
        elif kind == 3:
            text = text + " " + passage + "\n" + text.upper()
        elif kind == 4:
            text = " ".join(["same words again"] * rng.choice([2, 9, 30]))
        out.append((i, text, "en", "s", len(text or ""), 3, "x"))
    # Ids are not in the order of the rows.
    ids = list(range(0, 3 * n, 3))
    rng.shuffle(ids)
    out = [(ids[i], *r[1:]) for i, r in enumerate(out)]
    out += [(10_000, None, "en", "s", None, 1, "x"), (10_001, "", None, None, 0, 1, "x"), (10_002, " \t\n", "de", "s", 3, 1, "x")]
    out += [(None, out[3][1], "en", "s", 1, 1, "x"), out[5], (10_003, "x" * 70_000 + " tail", "en", "s", 1, 1, "x")]
    out += [(10_004, passage, "en", "s", 1, 1, "x"), (10_005, "end", "en", "s", 3, 1, "x")]
    return out
