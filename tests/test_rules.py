"""Row rules on small rows that hold what the tables do not: Chinese text, page frames, broken titles, model replies."""

import hashlib
import json

from inkwell.operators import chunking, rules
from inkwell.operators.answers import boilerplate, low_information
from inkwell.operators.search import keyword_heavy, reranked
from pyspark.sql import functions as F


def each(spark, rule, *rows):
    """The rule's value for each row of strings."""
    width = len(rows[0])
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"c{k} string" for k in range(width)))
    return [r[0] for r in df.orderBy("i").select(rule(*[F.col(f"c{k}") for k in range(width)])).collect()]


def test_titles(spark):
    assert each(spark, rules.synthetic_eval_title, ("smoke_1.pdf",), (" Test_x",), ("a.tmp.csv",), ("a.sample.csv",), ("报告",), (None,)) == [True, True, True, True, False, False]
    assert each(spark, rules.needs_new_title, ("",), (None,), ("???",), ("a?b?",), ("x�",), ("éàüö",), ("éàüö报",), ("报销",)) == [True, True, True, False, True, True, False, False]
    assert each(spark, rules.explicit_titles, ("请看《报销制度.docx》和《报销制度》",), ("《A》",), ("《Ab.PDF》",), (None,)) == [["报销制度.docx", "报销制度"], [], ["ab.pdf", "ab"], []]
    assert each(spark, rules.title_boost, ("报销制度(2024)", "《报销制度》说了什么"), ("别的", "《报销制度》"), (None, "《报销制度》")) == [0.8, 0.0, 0.0]
    assert each(spark, rules.about, ("出差Travel办法", "《travel》"), ("x", ""), ("x", "《》")) == [True, False, False]
    assert each(spark, rules.asks_for_relation, ("这个流程",), ("谁来负责",), ("金额多少",), (None,)) == [True, True, False, False]
    assert each(spark, keyword_heavy, ("HR-12",), ("2024 budget",), ("a/b",), ("plain words",)) == [True, True, True, False]
    assert each(spark, rules.version_scope, ("2024年版",), ("自2023-1-5起",), ("上一版",), ("无",)) == ["2024年", "2023-1-5", "上一版", ""]
    assert each(spark, rules.section_or_title, (" 总则 ", "T"), ("tmpabc_123", "T"), ("tmpx", "T"), (None, "T")) == ["总则", "T", "tmpx", "T"]


def test_snippets(spark):
    assert each(spark, low_information, ("", "t", "s"), ("报销制度", "报销制度.pdf", None), ("总则", "x", "总则"), ("报销制度-信息公开", "报销制度.html", None), ("信息公开栏", "x", "y"), ("第一条 员工出差应当提前申请", "x", "y"), ("附件： 地址： x", "t", "s")) == [True, True, True, True, True, False, True]
    assert each(spark, boilerplate, ("版权所有 邮编：400715",), ("版权所有",)) == [True, False]
    assert each(spark, rules.substantive, ("员工出差应当提前申请",), ("短",), ("附件 版权所有 员工出差应当提前申请",), ("abcdefgh",), ("a" * 20,), ("金额限额1200元xx",)) == [True, False, False, False, True, True]
    assert each(spark, rules.eval_worthy, ("| a |\n| - |\n| b |",), ("目录 第一章 总则 第二章",), ("已下载 12 次 发布日期 今天",), ("员工出差应当提前申请。",), ("短",)) == [True, False, False, True, False]
    assert each(spark, rules.no_graph, ("x", "Table"), ("", "text"), ("单位：万元 收入", "text"), ("1 2 3 4 5 6 7 8 合计", "text"), ("财务部负责审批报销", "text")) == [True, True, True, True, False]
    assert each(spark, rules.token_fingerprint, ("报销 a bc 12 制度x",)) == ["报销|bc|12|制度"]
    assert each(spark, rules.probe_query, ("T1 报销", "总则", "报销 b cc"), (None, None, "a - b")) == ["t1 报销 总则 cc", "a - b"]
    assert each(spark, rules.title_overlap, ("报销 制度 通知", "报销按制度办理"), (None, "x")) == [1, 0]
    assert each(spark, rules.export_sensitivity, ("工资和身份证",), ("工资",), ("无",)) == ["high", "medium", "low"]


def test_blocks(spark):
    assert each(spark, rules.text_blocks, ("a\n\nfirst line\nsecond line\n\n\nanother block",)) == [["first line second line", "another block"]]
    assert each(spark, rules.block_kind, ("第一章 总则",), ("| a | b |",), ("项目 金额 部门 合计：1",), ("本办法自发布之日起施行，由财务部解释。",)) == ["heading", "table", "table", "paragraph"]
    assert each(spark, rules.guessed_section, ("总则。正文", "f"), ("。", "f"), ("x" * 50, "f")) == ["总则", "f", "f"]
    kinds = lambda c: rules.collapsed_kind(F.split(c, ","))
    assert each(spark, kinds, ("text,table,heading",), ("text,heading",), ("ocr_page",), ("text",)) == ["table", "heading", "ocr_page", "text"]


def test_answers_and_training_rows(spark):
    assert each(spark, rules.best_sentence, ("报销 多少", "出差。报销上限一千；报销"), ("x", ""), ("报销", "出差。 0报销1 ；无")) == ["报销上限一千", None, "0报销1"]
    split = lambda c: rules.duty_sentence(F.split(c, "。"), c)
    assert each(spark, split, ("说明。员工应当申请。完",), ("只有说明",)) == ["员工应当申请", "只有说明"]
    versions = lambda c: rules.version_sentence(F.split(c, "。"))
    assert each(spark, versions, ("2023年发布。自2024年1月起施行。完",), ("无",)) == ["自2024年1月起施行", None]
    text = lambda a, b, c, d: rules.training_text(a, b, c, d)
    assert each(spark, text, ("T", "S", "3", "body"), ("T", None, None, "body")) == ["文档标题：T\n章节：S\n页码：3\n\nbody", "文档标题：T\n\nbody"]
    summary = each(spark, rules.rule_summary, ("一。二；三\n四四。",), ("",))
    assert summary[0].startswith("1. 一\n2. 二\n3. 三\n执行风险：") and "“四四”" in summary[0] and summary[1].startswith("1. 未提取到明确管理要点\n") and "原文信息不足" in summary[1]


def test_lenient_metadata_and_replies(spark):
    got = each(spark, rules.lenient_map, ('{"a": "1", "b": null}',), ("{'a': True, 'b': None}",), ("not json",), (None,), ("[1]",))
    assert got == [{"a": "1", "b": None}, {"a": "true", "b": None}, {}, {}, {}]
    merged = lambda a, b: rules.merged_maps(rules.lenient_map(a), rules.lenient_map(b))
    assert each(spark, merged, ('{"a": "1", "b": "2"}', '{"b": "3", "c": "4"}')) == [{"a": "1", "b": "3", "c": "4"}]
    pairs = json.dumps([{"q": "x [1]", "a": "y"}])
    read = lambda c: rules.listed(c, "array<struct<q:string,a:string>>")
    for row in each(spark, read, (pairs,), (f"Sure:\n```json\n{pairs}\n```\nDone",), (f"The list {pairs} follows",)):
        assert [tuple(x) for x in row] == [("x [1]", "y")]
    assert each(spark, read, ("no list",)) == [None]
    assert each(spark, rules.looks_numeric, ("1,200.5",), (" 12 ",), ("1e",), ("",), ("abc",)) == [True, True, False, False, False]


def test_chunk_tree_of_small_documents(spark):
    body = [" ".join(f"w{i}" for i in range(500)) + ".", "Heading", "tail of the text."]
    docs = spark.createDataFrame([(5, body), (6, []), (2**60 + 1, ["one line."]), (7, None)], "doc_id bigint, pieces array<string>")
    rows = [tuple(r) for r in rules.chunk_rows(docs).orderBy("doc_id", "chunk_index").collect()]
    sha = lambda *k: hashlib.sha256("|".join(map(str, k)).encode()).hexdigest()
    want = []
    for doc_id, pieces in ((5, body), (2**60 + 1, ["one line."])):
        i = 0
        for p, (first, n, _) in enumerate(chunking.segments(pieces)):
            ws = "\n".join(pieces[first : first + n]).split()
            starts = range(0, max(0, -(-(len(ws) - rules.CHILD_WORDS) // rules.CHILD_STRIDE)) * rules.CHILD_STRIDE + 1, rules.CHILD_STRIDE)
            for c, part in enumerate([ws] + [ws[s : s + rules.CHILD_WORDS] for s in starts]):
                want.append((doc_id, i, p, c, sha(doc_id, p, c), sha(doc_id, p, 0) if c else None, len(part)))
                i += 1
    assert rows == want and len({r[4] for r in rows}) == len(rows)


def test_full_rerank_prefers_named_departments_titles_and_fresh_dates(spark):
    found = spark.createDataFrame([("q", d, 1.0, 0.1) for d in range(4)], "item_id string, doc_id bigint, score double, rrf_score double")
    shown = spark.createDataFrame([(0, "报销制度", "总则", "正文", "财务部", "2025-12-20"), (1, "报销制度", "总则", "正文", "人事部", "2025-12-20"), (2, "其他", "报销制度", "报销", "人事部", "2020-01-01"), (3, "其他", None, "无", None, None)], "doc_id bigint, title string, section string, content string, department string, updated string")
    asked = spark.createDataFrame([("q", "报销制度", ["报销制度"])], "item_id string, phrase string, ts array<string>")
    out = reranked(found, shown, asked, "2026-01-01", 10).orderBy("rank").collect()
    scores = {r["doc_id"]: r["rerank_score"] for r in out}
    assert scores[3] == 1.0 and scores[2] == 6.6 and scores[1] == 15.8 and scores[0] >= scores[1]
    assert [r["doc_id"] for r in out][-2:] == [2, 3]
