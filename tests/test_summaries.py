"""Topics, conversation summaries and tree summaries against plain Python."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import summaries as sm


def test_topics(spark):
    cases = {
        "什么是PID控制？": "PID 控制器", "闭环系统是什么？": "闭环系统", "生产流程包括哪些阶段？": "生产流程", "请介绍 PLC 的 扫描周期。": "PLC 扫描周期", "讨论主题：稳态误差 用户问题：你好；什么是积分饱和？": "积分饱和",
        "讨论主题：稳态误差 用户问题：你好": "稳态误差", "当前讨论主题: 反馈控制。其他": "反馈控制", "how does pid 控制器 work": "pid 控制器", "说说PLC扫描周期吧": "PLC扫描周期", "nothing here": "", "": "", None: "",
        "什么是" + "长" * 200: "长" * 120, "用户问题：什么是甲；乙是什么": "乙",
    }
    df = spark.createDataFrame([(k,) for k in cases], "text string")
    assert {r["text"]: r["t"] for r in df.select("text", sm.topic(F.col("text")).alias("t")).collect()} == cases


def test_conversations(spark):
    r = random.Random(1)
    words = ["PID", "plc", "积分饱和", "积分", "扫描周期", "闭环系统", "稳态误差", "反馈控制", "微分项", "比例", "输入响应", "hello\n world", "", None]
    turns = [(c, t, r.choice(["user", "assistant"]), r.choice(words)) for c in range(50) for t in range(r.randint(1, 9))] + [(99, 0, "assistant", "hi")]
    got = {x["conv_id"]: x["summary"] for x in sm.turn_summaries(spark.createDataFrame(turns, "conv_id int, turn int, role string, text string"), 60).collect()}
    for c in {t[0] for t in turns}:
        mine = [(role, text or "") for k, _, role, text in sorted((t for t in turns if t[0] == c), key=lambda t: t[1])]
        said, found = " ".join(t for _, t in mine), []
        for p in sm.TERMS:
            if (m := re.search(p, said, re.I)) and m[0] not in found:
                found.append(m[0])
        asked = [t for role, t in mine if role == "user"][-3:]
        parts = ["讨论主题：" + "、".join(found[:6])] * bool(found) + ["用户问题：" + "；".join(asked)] * bool(asked)
        assert got[c] == " ".join(" ".join(parts or [sm.NO_TOPIC]).split())[:60].rstrip()


def brute(docs, batch, kept):
    rows = {}
    for c, d, text in docs:
        for p, s in enumerate(re.findall(sm.SENTENCE, text or "")):
            if s.strip(" "):
                rows.setdefault(c, []).append((d, p, s.strip(" ")))
    out = []
    for c, left in rows.items():
        level = 0
        while True:
            level, at, batches = level + 1, 0, {}
            for d, p, s in sorted(left):
                batches.setdefault(at // batch, []).append((-len(set(re.split(" +", s))), d, p, s))
                at += len(s)
            left = []
            for b in batches.values():
                used = 0
                for n, (_, d, p, s) in enumerate(sorted(b), 1):
                    used += len(s)
                    if used <= kept or n == 1:
                        left.append((d, p, s))
                        last = (c, n, d, p, s, level)
                        if len(batches) == 1:
                            out.append(last)
            if len(batches) == 1:
                break
    return sorted(out)


@pytest.mark.parametrize("blocks", [2, 12])
def test_tree_summary(spark, blocks):
    r = random.Random(blocks)
    say = lambda: " ".join(r.choice("a bb ccc dddd é".split()) for _ in range(r.randint(1, 12))) + r.choice([".", "!", "\n", "。", ""])
    docs = [(r.choice(["hot"] * 4 + ["b", "c"]), i, " ".join(say() for _ in range(r.randint(0, 8)))) for i in range(120)] + [("b", 900, None), ("one", 901, "x"), ("none", 902, " \n ")]
    df = spark.createDataFrame(docs, "collection string, doc int, text string").repartition(4)
    got = sm.tree_summary(sm.sentences(df), 300, 90, blocks)
    want = brute(docs, 300, 90)
    assert sorted(tuple(x) for x in got.collect()) == want
    levels = {w[0]: w[5] for w in want}
    assert levels["hot"] >= 3 and levels["one"] == 1 and "none" not in levels
    assert all(sum(len(w[4]) for w in want if w[0] == c) <= 90 or sum(w[0] == c for w in want) == 1 for c in levels)


def test_nothing(spark):
    df = spark.createDataFrame([], "collection string, doc int, text string")
    assert sm.tree_summary(sm.sentences(df)).count() == 0
