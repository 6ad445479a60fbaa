from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.llm import chat, queries
from tests.llm import brute

SCHEMA = "conv_id long, turn int, role string, text string, span string"


def as_dict(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


def test_query(spark, sf_dir):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    said = "</s>[INST] ok [/INST]"
    rows += [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    assert as_dict(queries.op8_chat(spark, sf_dir)) == brute.chats(rows)


ROWS = [
    (1, 0, "user", None), (1, 1, "assistant", ""), (2, None, None, "no turn, no role"), (2, 0, "assistant", "~0 ~~ <|end|>\n<|turn|>assistant<|text|>x"), (None, 3, "user", "nobody"), (None, 1, "assistant", "é\U0001f600"),
    (3, 0, "user", "same"), (3, 0, "user", "same"), (3, 0, "assistant", "tie"), (4, 0, "assistant", "y" * 300_000), (5, 0, "as~sis<|tant", "odd role"), (6, 0, "assistant", "[INST][/INST]<<SYS>><</SYS>><s></s>"),
] + [(7, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(500)]


def test_edges(spark):
    rows = [(*r, "clash") for r in ROWS]
    df = spark.createDataFrame(rows, SCHEMA)
    assert as_dict(chat.digests(df)) == brute.chats(ROWS)
    assert as_dict(chat.digests(df.repartition(5))) == brute.chats(ROWS)
    assert chat.digests(df.limit(0)).count() == 0


def test_formatted_chars_and_masks(spark):
    df = spark.createDataFrame([(*r, "") for r in ROWS], SCHEMA)
    chars = {r.conv_id: r.formatted_chars for r in chat.digests(df).collect()}
    spans = chat.formatted(df).collect()
    for conv in chars:
        own = sorted((s for s in spans if s.conv_id == conv), key=lambda s: s.seq)
        assert sum(len(s.span) for s in own) == chars[conv]
        loss = "".join(chat.unescape(s.span[s.mask_start : s.mask_end]) for s in own)
        assert (len(loss), brute.sha(loss)) == brute.chats(ROWS)[conv][2:]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=8), st.text(alphabet="~0123<|>turnsaid/[]INST \n", max_size=40)), max_size=6))
def test_round_trip(turns):
    spans = list(chat.spans(turns))
    assert "".join(spans) == chat.template(turns)
    assert [chat.parse(s) for s in spans] == turns
    for _, t in turns:
        assert not any(c in chat.escape(t) for c in ("<|", "[INST]", "</s>"))


def test_templates_that_rewrite_history_are_found():
    def counting(turns):
        return f"{len(turns)} turns\n" + "".join(t for _, t in turns)

    def trimming(turns):
        return "".join(t if i + 1 < len(turns) else t + "<last>" for i, (_, t) in enumerate(turns))

    turns = [("user", "a"), ("assistant", "b"), ("user", "c")]
    assert chat.rewrites(turns, counting) and chat.rewrites(turns, trimming)
    assert not chat.rewrites(turns, chat.template)
    with pytest.raises(chat.RewritesHistory):
        list(chat.spans(turns, trimming))


def test_headers_that_depend_on_the_place(spark):
    """A template whose first turn differs keeps its spans right beyond the turns rendered in full."""
    def opened(turns):
        return "".join(("<s>" if i == 0 else "") + chat.template([t]) for i, t in enumerate(turns))

    turns = [("user", f"{i}") for i in range(60)]
    assert "".join(chat.spans(turns, opened)) == opened(turns)


def last_thirty(turns):
    return chat.template(turns[-30:])


def from_turn_forty(turns):
    return chat.template([("system", "long"), *turns[1:]] if len(turns) > 40 else turns)


@pytest.mark.parametrize("render", [last_thirty, from_turn_forty])
@pytest.mark.parametrize("n", [44, 60, 200])
def test_rewrites_of_long_conversations_only_are_found(render, n):
    turns = [("user", f"{i}") for i in range(n)]
    with pytest.raises(chat.RewritesHistory):
        list(chat.spans(turns, render))


def test_rewrites_of_long_conversations_fail_queries(spark):
    df = spark.createDataFrame([(7, i, "user", f"{i}", "") for i in range(44)], SCHEMA)
    trimmed = lambda turns: chat.template(turns[-30:])
    for found in (chat.digests, chat.formatted):
        with pytest.raises(Exception, match="changes what was written before"):
            found(df, trimmed).collect()


def test_late_turns_that_depend_on_the_place_keep_right_spans():
    def marked(turns):
        return "".join(("<half>" if i == 30 else "") + chat.template([t]) for i, t in enumerate(turns))

    for n in (24, 25, 31, 48, 49, 100):
        turns = [("user", f"{i}") for i in range(n)]
        assert list(chat.spans(turns, marked)) == [("<half>" if i == 30 else "") + chat.template([t]) for i, t in enumerate(turns)]


def summarised(turns):
    return ("[summary]" if len(turns) > 30 else "") + chat.template(turns)


def test_a_summary_put_before_a_long_conversation_is_found(spark):
    turns = [("user", f"{i}") for i in range(40)]
    with pytest.raises(chat.RewritesHistory):
        list(chat.spans(turns, summarised))
    df = spark.createDataFrame([(7, i, "user", f"{i}", "") for i in range(40)], SCHEMA)
    with pytest.raises(Exception, match="changes what was written before"):
        chat.digests(df, lambda turns: ("[summary]" if len(turns) > 30 else "") + chat.template(turns)).collect()


def test_a_template_that_wrongly_says_it_is_local():
    """It is found out at the next whole prefix, and spans are those of rendering all of them."""
    def late(turns):
        return "".join(("<half>" if i == 30 else "") + chat.template([t]) for i, t in enumerate(turns))

    def rewriting(turns):
        return summarised(turns)

    late.local = rewriting.local = True
    turns = [("user", f"{i}") for i in range(100)]
    assert list(chat.spans(turns, late)) == list(chat.spans(turns, late, whole=True))
    with pytest.raises(chat.RewritesHistory):
        list(chat.spans(turns, rewriting))
    assert list(chat.spans(turns)) == list(chat.spans(turns, whole=True))
