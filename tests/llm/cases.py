"""Documents that the operators must survive: nulls, empties, ties, repeats, long texts, clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def awkward(seed: int = 5) -> list[tuple]:
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 9))) for _ in range(60)]
    prose = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    base, shared = prose(120), prose(40)
    rows = [
        (1, base, "en", "a", 1),
        (2, base, "en", "a", 1),
        (3, base.replace(" ", "\n\t", 3) + " ", "fr", "b", 1),
        (4, None, "en", None, None),
        (5, "", "en", "a", 0),
        (6, " \n\t ", None, "b", 4),
        (None, prose(30), "de", "c", 1),
        (None, prose(30), "de", "c", 1),
        (8, "x" * 5000, "en", "c", 1),
        (9, "ab" * 3000 + prose(5), "en", "c", 1),
        (10, prose(50) + shared + prose(50), "en", "a", 1),
        (11, prose(20) + shared + prose(3), "en", "a", 1),
        (12, shared, "en", "", 1),
        (12, prose(60), "en", "", 1),
        (13, prose(9), "en", "d", 1),
        (13, prose(9), "en", "d", 1),
        (14, base[:-7] + "changed", "en", "a", 1),
        (15, prose(20000), "en", "a", 1),
        (16, "日本語の文章です。" * 40 + " 😀     end", "ja", "a", 1),
        (17, "  ", "en", "a", 1),
        (18, "password = 'hunter22' token:abc SECRET=abcdefgh AKIA" + "A1" * 12 + " " + "0f" * 15 + " ghp_" + "a1B2" * 9, "en", "a", 1),
        (19, "api_key: short Passwd=\"long-enough/value\"" + " deadbeef" * 3 + "cafe" * 8, "en", "a", 1),
    ]
    rows += [rows[0], rows[0]]
    rows += [(100 + k, " ".join(base.split()[: 100 + k % 7] + ["w%d" % (k % 5)]), "en", "a", 1) for k in range(30)]
    return rows


def documents(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)
