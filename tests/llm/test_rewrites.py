"""Templates that rewrite history, in conversations of any length."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from prismview.llm import chat

TURNS = [(["user", "assistant"][k % 2], f"text {k}") for k in range(200)]


def forgets(back):
    """A template that empties texts more than so many turns back."""
    return lambda turns: "".join(f"[{r}]{t if k >= len(turns) - back else ''};" for k, (r, t) in enumerate(turns))


def replaces(n):
    """A template that replaces the first turn from n turns on."""
    return lambda turns: "".join(f"[{r}]{'gone' if k == 0 and len(turns) >= n else t};" for k, (r, t) in enumerate(turns))


def shown(template, turns, **kw):
    c = chat.Conversation(template, **kw)
    spans = [c.add(*t) for t in turns]
    c.close()
    return "".join(s for s, _, _ in spans)


@pytest.mark.parametrize("template,first,latest", [(forgets(60), 60, 63), (replaces(50), 49, 50), (replaces(150), 149, 168), (forgets(33), 33, 36)])
def test_rewriting_is_found_soon(template, first, latest):
    assert chat.rewrites(template, TURNS) == first
    c, at = chat.Conversation(template), 0
    with pytest.raises(chat.Rewrites):
        for at, turn in enumerate(TURNS):  # noqa: B007
            c.add(*turn)
    assert first <= at <= latest


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 130), st.integers(1, 130), st.sampled_from([forgets, replaces]))
def test_joined_spans_are_the_output_or_it_raises(n, k, kind):
    template, turns = kind(k), TURNS[:n]
    try:
        assert shown(template, turns) == template(turns)
    except chat.Rewrites as e:
        assert str(e) == f"turn {chat.rewrites(template, turns)} changes what stands before it"
    else:
        # a change that is undone by the end is not seen
        assert chat.rewrites(template, turns) is None


def test_rewriting_at_the_last_turn_is_found():
    for n in range(34, 80):
        with pytest.raises(chat.Rewrites):
            shown(replaces(n), TURNS[:n])


def test_looking_far_back_is_no_rewriting():
    # from turn 100 on each turn names the first one's text, which windows can't show
    def naming(turns):
        return "".join(f"[{r}]{t}({turns[0][1] if k >= 100 else ''});" for k, (r, t) in enumerate(turns))

    assert chat.rewrites(naming, TURNS) is None
    for reach in (None, 0):
        with pytest.raises(chat.LooksFar):
            shown(naming, TURNS, reach=reach)
    assert shown(naming, TURNS, window=float("inf")) == naming(TURNS)


def test_a_known_reach_bounds_what_is_kept(monkeypatch):
    monkeypatch.setattr(chat, "CHECKED", 500)
    c = chat.Conversation(chat.chatml, reach=0)
    out = "".join(c.add(*t)[0] for t in TURNS)
    c.close()
    assert c.all is None and len(c.turns) <= chat.WINDOW and out == chat.chatml(TURNS)
    # a template that looks at the turn before is rendered right with its reach
    pairs = lambda turns: "".join(f"<{r}>{t}{len(turns[k - 1][1]) if k else ''}" for k, (r, t) in enumerate(turns))
    assert shown(pairs, TURNS, reach=1) == pairs(TURNS)


def test_rewriting_fails_the_job(spark):
    rows = [(1, k, *TURNS[k]) for k in range(60)] + [(2, k, *TURNS[k]) for k in range(70)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    with pytest.raises(Exception, match="turn 65 changes what stands before it"):
        chat.render(df, forgets(65)).collect()
    got = chat.render(df, forgets(70)).orderBy("conv_id", "position").collect()
    assert ["".join(r["formatted"] for r in got if r["conv_id"] == c) for c in (1, 2)] == [forgets(70)(TURNS[:n]) for n in (60, 70)]
