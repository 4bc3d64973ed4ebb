import hashlib
import json
import random

import pytest

from lakedoc.llm import chat_format as C


def test_template_is_reversible():
    rng = random.Random(8)
    parts = [*"[]</s>\\ \n|", "[INST]", "[/INST]", "[SYS] ", " [/SYS]", "</s>", "<s>", " [/TURN]",
             "[TURN] ", "ok", "é", "INST", "user"]
    for _ in range(3000):
        turns = [
            (rng.choice(["user", "assistant", "system", "tool", "", "User", "x [/TURN]\\"]),
             "".join(rng.choices(parts, k=rng.randint(0, 8))))
            for _ in range(rng.randint(0, 5))
        ]
        text = "<s>" + "".join(C.turn_text(r, t)[0] for r, t in turns)
        assert C.parse(text) == turns


def test_digests_against_brute_force(spark):
    rows = [
        (1, 2, "assistant", "b</s>"), (1, 1, "user", "a\\"), (1, 1, "user", "a\\"), (2, 1, None, None),
        (3, None, "system", ""), (3, 0, "assistant", "é" * 50_000), (None, 1, "user", "x"),
        *C.PROBE,
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    table = table.withColumns({"loss": table["role"], "layout": table["text"]})
    got = {r.conv_id: r for r in C.formatted_digests(C.canonical_turns(table)).collect()}
    assert set(got) == {1, 2, 3, None, -7}
    for conv, r in got.items():
        own = [(t is not None, t or 0, a or "", b or "") for c, t, a, b in rows if c == conv]
        turns = [(a, b) for *_, a, b in sorted(own)]
        said = "".join(f"{a}\n{b}\n" for a, b in turns)
        loss = "".join(b for a, b in turns if a == "assistant")
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == 3 + sum(len(C.turn_text(a, b)[0]) for a, b in turns)
    assert C.formatted_digests(C.canonical_turns(table.limit(0))).collect() == []


RECORDS = [
    {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
    {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
    {"prompt": "q", "response": "a", "id": 5},
    {"prompt": "q", "completion": "a"},
    {"instruction": "q", "input": "", "output": "a"},
    {"question": "q", "answer": "a"},
]
TURNS = [("user", "q"), ("assistant", "a")]


@pytest.mark.parametrize("record", RECORDS)
def test_typed_layouts(spark, record):
    table = spark.read.json(spark.sparkContext.parallelize([json.dumps({**record, "conv_id": 1})]))
    got = C.canonical_turns(table).orderBy("turn").collect()
    assert [(r.role, r.text) for r in got] == TURNS


def test_mixed_json_records(spark):
    odd = ["not json", "{}", None, "[1]", json.dumps({"title": "x"})]
    texts = [json.dumps(r) for r in RECORDS] + odd
    table = spark.createDataFrame(list(enumerate(texts)), "conv_id long, record string")
    by_conv = {}
    for r in C.turns_of_json(table).orderBy("turn").collect():
        by_conv.setdefault(r.conv_id, []).append(r)
    for i in range(len(RECORDS)):
        assert [(r.role, r.text) for r in by_conv[i]] == TURNS and by_conv[i][0].layout
    for i in range(len(RECORDS), len(texts)):
        assert [(r.layout, r.role) for r in by_conv[i]] == [(None, None)]


def test_fingerprints_tell_layouts_apart():
    assert len(set(C.MAPPINGS)) == sum(2 ** len(x.optional) for x in C.LAYOUTS)
    assert C.layout_of(["title"]) is None
