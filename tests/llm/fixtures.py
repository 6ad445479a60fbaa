"""Tables with what real ones rarely hold: nulls, repeats, ties, very long texts, clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, score double, doc long, bucket long"


def edge_texts(seed: int = 3) -> list[tuple[int | None, str | None]]:
    r = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "delta", "ünï", "日本語", "x", "token", "=", "12", "don't"]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    long = say(30_000)
    passage = say(60)
    one = say(50)
    return [
        (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one"), (5, "ONE"), (6, "one two"), (7, "two one"),
        (8, long), (9, long.upper()), (10, long + " tail"), (11, passage), (12, say(20) + passage + say(20)), (13, say(5) + passage),
        (14, one), (15, one + " more"), (16, one.replace("alpha", "omega", 1)), (17, "a" * 5000), (18, "a" * 5001), (19, "ab" * 700),
        (20, "\x1c\x1d \x85\xa0  　 é É İ ſ K Σς \U0001f600 <|startoftext|> <|endoftext|>"), (21, one), (21, one), (22, "password: hunter2hunter2"),
        (-5, "negative ids count as well"), (2**40, "and so do large ones"),
    ]


def edge_rows(seed: int = 3) -> list[tuple]:
    """Rows of SCHEMA: some sources null, columns that clash with names that operators use."""
    return [(d, t, None, None if i % 5 == 0 else f"s{i % 4}", None, 7, "k", 0.5, 99, 1) for i, (d, t) in enumerate(edge_texts(seed))]


def with_nulls(seed: int = 3) -> list[tuple]:
    """As edge_rows, with null ids and ids that repeat with other texts."""
    more = [(None, "no id here at all"), (None, None), (4, "another text of the same id"), (None, "no id here at all")]
    return edge_rows(seed) + [(d, t, None, "s1", None, 7, "k", 0.5, 99, 1) for d, t in more]
