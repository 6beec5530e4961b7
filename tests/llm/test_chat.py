import random

import pytest
from pyspark.sql import functions as F

from turnweave.llm import chat

EVENTS = "conv_id bigint, seq bigint, message bigint, kind string, role string, text string"


def fold(events):
    out = {}
    for conv, seq, message, kind, role, text in sorted(events, key=lambda e: (e[0], e[2], e[1])):
        kind, text = kind or "delta", text or ""
        key = conv, message
        if kind == "delete":
            out.pop(key, None)
        elif kind == "delta" and key in out:
            out[key] = role or "", out[key][1] + text
        else:
            out[key] = role or "", text
    return out


def test_reconstruction_is_the_fold(spark):
    rng = random.Random(6)
    events = [(c, s, rng.randint(0, 4), rng.choice(["delta", "delta", "delta", "edit", "regenerate", "delete", None]), rng.choice(["user", "assistant"]), rng.choice(["a", "<turn", "\n", None, "é"])) for c in range(30) for s in range(rng.randint(1, 25))]
    found = {(r.conv_id, r.message): (r.role, r.text) for r in chat.reconstruct(spark.createDataFrame(events, EVENTS)).collect()}
    assert found == fold(events)


def test_round_trip_and_mask(spark):
    rng = random.Random(7)
    parts = ["</turn>", "<turn user>\n", "\\", "<\\/turn>", "<\\\\turn", ">\n", "\n", "</turn>\n", "é\U0001f600", "", "### Assistant: "]
    rows = [(c, m, rng.choice(["user", "assistant", "a>\n\\b", ""]), "".join(rng.choices(parts, k=rng.randint(0, 6)))) for c in range(40) for m in range(rng.randint(1, 8))]
    rendered = chat.render(spark.createDataFrame(rows, "conv_id bigint, message bigint, role string, text string"))
    back = {r.conv_id: r for r in chat.read_back(rendered).collect()}
    for r in rendered.collect():
        own = [(role, text) for c, _, role, text in sorted(rows, key=lambda x: x[:2]) if c == r.conv_id]
        assert [tuple(t) for t in back[r.conv_id].turns] == own
        assert back[r.conv_id].loss_text == "".join(t for role, t in own if role == "assistant")
        for span in r.loss_spans:
            assert r.formatted[span.start - 11 : span.start] == "assistant>\n" and r.formatted[span.end :].startswith(chat.TERMINATOR)


@pytest.mark.parametrize("wrong", ["shifted", "short", "missing", "twice", "disordered", "other"])
def test_wrong_masks_fail(spark, wrong):
    rows = [(1, m, "assistant" if m % 2 else "user", f"text <turn {m}> é") for m in range(6)]
    rendered = chat.render(spark.createDataFrame(rows, "conv_id bigint, message bigint, role string, text string"))
    span = lambda by, end: f"transform(loss_spans, s -> named_struct('turn', s.turn, 'start', s.start + {by}, 'end', s.end + {end}))"
    masks = {
        "shifted": span(-9, -9),
        "short": span(0, -1),
        "missing": "slice(loss_spans, 1, 2)",
        "twice": "concat(loss_spans, slice(loss_spans, 3, 1))",
        "disordered": "reverse(loss_spans)",
        "other": "transform(loss_spans, s -> named_struct('turn', s.turn - 1, 'start', s.start, 'end', s.end))",
    }
    assert chat.read_back(rendered).first().loss_text == "".join(t for _, _, r, t in rows if r == "assistant")
    with pytest.raises(Exception, match="loss mask"):
        chat.read_back(rendered.withColumn("loss_spans", F.expr(masks[wrong]))).collect()


def test_long_conversation(spark):
    rows = [(1, m, "assistant" if m % 2 else "user", "é" * (m % 7)) for m in range(3000)]
    rendered = chat.render(spark.createDataFrame(rows, "conv_id bigint, message bigint, role string, text string"))
    back = chat.read_back(rendered).first()
    assert back.loss_text == "".join(r[3] for r in rows if r[2] == "assistant") and len(back.turns) == 3000


def test_no_events(spark):
    assert chat.read_back(chat.render(chat.reconstruct(spark.createDataFrame([], EVENTS)))).count() == 0


def test_plan_is_native(spark):
    frame = chat.read_back(chat.render(chat.reconstruct(spark.createDataFrame([], EVENTS))))
    assert "Python" not in frame._jdf.queryExecution().executedPlan().toString()
