"""Points, matches, entities and questions on small rows that hold the words of the rules."""

from inkwell.operators import analytics, questions, scores
from pyspark.sql import functions as F

from tests.test_rules import each


def paged(rule, at):
    """rule with the column number at read as a number."""
    return lambda *c: rule(*[x.cast("int") if i == at else x for i, x in enumerate(c)])


def test_chunk_priority(spark):
    plain, detailed = (paged(lambda t, s, x, p, q, d=d: scores.chunk_priority(t, s, x, p, q, d), 3) for d in (False, True))
    assert each(spark, plain, ("T", "S", "短", "1", "x"), ("T", "T", "万元", "2", "x"), ("x", "y", "差旅费是指出差的费用", "3", "核心要求"), ("x", "y", "提交材料", "3", "需要什么"), ("x", "y", "提交材料", None, None)) == [0, 2, 14, 10, 0]
    assert each(spark, plain, ("报销", "y", "报销" + "a" * 118, "1", None), ("x", "y", "责任 关于印发", "12", "要点")) == [5, -17]
    assert each(spark, detailed, ("常见问题", "", "常见问题解答 一、报到", "1", "概括一下"), ("x", "2 如何", "目录", "1", "总结"), ("x", "y", "1 附件", "3", "")) == [33, -22, 18]


def test_summary_primary_and_sample_points(spark):
    assert each(spark, paged(scores.summary_priority, 3), ("总则", "总则", "适用范围", "1"), ("x", "2 流程", "目录 a", "9"), ("x", "", "a" * 60, "2")) == [43, -21, 6]
    assert each(spark, paged(scores.primary_points, 1), ("总则 审批", "3"), ("责任", "12"), ("x", None)) == [16, -8, 0]
    sample = paged(scores.eval_points, 3)
    assert each(spark, sample, ("", "", "", "9"), ("预算.pdf", "总则", "金额 12,345", "9"), ("x", "", "目录", "2"), ("x", "", "a." * 20, None)) == [-100, 18, -28, -24]


def test_hits_and_table_cells(spark):
    keys = ("chunk_id", "doc_id", "title", "section", "content")
    match = lambda *c: scores.hit_matches(dict(zip(keys, c[:5], strict=True)), dict(zip(keys, c[5:], strict=True)))
    none = (None,) * 5
    rows = [("1", *none[1:], "1", *none[1:]), (None, "d", *none[2:], None, "d", *none[2:]), (None, None, "T", "S ", None, None, None, " t", "s", None), (*none[:4], "ab cd ef gh xx", *none[:4], "AB cd ef gh"), (*none[:4], "ab cd", *none[:4], "ab ef"), none + none]
    assert each(spark, match, *rows) == [True, True, True, True, False, False]
    text = "| policy content | v |\n| --- | --- |\n| Annual leave | 5 days |\n| Travel | 100 |"
    assert each(spark, scores.table_cell, ("年假有几天", text), ("报销", text), ("travel cost", text), ("q", "no table"), (None, None)) == ["5 days", "100", "100", "", ""]


def test_entities(spark):
    names = ("财务部", "合同", "2024年", "第三条", "一", "附件", "对于报销的审批事项人员", "由财务部统一安排", "12万元以上", "为了更好", "通知通过", "123", "HR")
    assert each(spark, scores.valid_entity, *[(n,) for n in names]) == [True, True, *[False] * 10, True]
    assert each(spark, scores.entity_parts, ("财务部负责采购合同",), ("负责",), ("abc",)) == [["财务部", "采购合同"], [], []]
    assert each(spark, scores.entity_names, ("财务部负责采购合同。2024年 财务部",), (None,)) == [["财务部", "采购合同"], []]
    assert each(spark, scores.asked_relation, ("引用了哪些", ""), ("x", "替代旧版"), ("x", "审批"), ("上级是谁", ""), (None, None)) == ["references", "amends", "manages", "reports_to", "related_to"]


def test_normalised(spark):
    rows = [
        (1, "a", "t", "s", "员工出差应当提前提交申请并附上预算说明文件", 1.0, 1, 0), (1, "a", "t", "s", "员工出差应当提前提交申请并附上预算说明文件", 0.9, 2, 0), (1, "a", "t", "u", "报销需要在三十日之内完成并附上所有的原始票据", 0.8, 3, 5),
        (1, "a", "t", "v", "超出标准的部分由个人承担而且不得以其他方式补足", 0.7, 4, 4), (1, "b", "t", "s", "住宿费按照实际发生的金额在限额以内据实进行报销", 0.1, 5, 1), (1, "c", "t", "s", "", 9.0, 6, 9),
    ]
    hits = spark.createDataFrame(rows, "item int, doc_id string, title string, section string, snippet string, score double, rank int, priority int")
    taken = lambda **k: [(r.doc_id, r.rank) for r in scores.normalised(hits, "item", 2, **k).orderBy("place").collect()]
    assert taken() == [("a", 3), ("a", 4), ("b", 5)]
    assert taken(all_documents=True) == [("a", 3), ("b", 5), ("a", 4)]
    assert taken(named=F.col("doc_id") == "b") == [("b", 5)]
    assert taken(named=F.col("doc_id") == "nowhere") == [("a", 3), ("a", 4), ("b", 5)]


def test_questions(spark):
    assert each(spark, questions.named_titles, ("看《报销办法》和《 报销办法 》",), ("《a》",), (None,)) == [["《报销办法》"], [], []]
    assert each(spark, questions.referenced_titles, ("[参考文档: 报销办法、《差旅》, ]",), ("x",), (None,)) == [["《报销办法》", "《差旅》"], [], []]
    assert each(spark, questions.subject_of, ("请问《差旅办法》怎么用",), ("2024 采购管理办法。何时生效",), ("你好。再见",), ("",), (None,)) == ["《差旅办法》", "2024 采购管理办法", "你好", None, None]
    assert each(spark, questions.follow_up, ("何时生效",), ("那呢",), ("真的?",), ("介绍公司",), (None,)) == [True, True, True, False, False]
    assert each(spark, questions.leans, ("它的长度",), ("旧版内容",), ("介绍公司",)) == [True, True, False]
    assert each(spark, questions.by_title, ("《差旅办法》讲什么", "qa"), ("《差旅办法》", "compare"), ("《差旅办法》", "qa"), ("讲什么", "qa")) == ["差旅办法 主要内容 要点", "差旅办法 版本 差异", None, None]
    rows = (("需要哪些", "《差旅》", "qa"), ("多少钱", "差旅", "qa"), ("差旅多少钱", "差旅", "qa"), ("多少钱", "差旅", "process"))
    assert each(spark, questions.with_subject, *rows) == ["《差旅》 材料 要求；补充问题：需要哪些", "差旅；补充问题：多少钱", "差旅多少钱", "《差旅》 流程 审批；补充问题：多少钱"]
    texts = ("差旅报销办法", "ab", "# 标题很长", "材料如下：一", "a?b?c?", "x" * 121, "abcdef", "abc", "1. 报销", "报销\n办法", None)
    assert each(spark, questions.valid_rewrite, *[(t,) for t in texts]) == [True, False, False, False, False, False, True, False, False, False, False]


def test_answers(spark):
    rows = (("summary", "qa", "x"), ("summary", "qa", "### 关键要点"), ("compliance", "qa", "x"), ("compliance", "qa", "**结论：** x"), ("qa", "compare", "x"), ("qa", "compare", "无法完成可靠对比"), (None, None, None))
    assert each(spark, questions.structure_problem, *rows) == ["summary", None, "conclusion", None, "comparison", None, None]
    assert each(spark, questions.evidence_fields, ("提交聘用合同和人事档案、聘用合同，入职后 3 个月内",), (None,)) == [["- 所需材料：聘用合同、人事档案", "- 时间要求：入职后 3 个月内"], []]
    keys = ("faithfulness", "relevancy", "precision")
    poor = lambda *c: questions.degenerate(dict(zip(keys, [x.cast("double") for x in c[:3]], strict=True)), dict(zip(keys, [x.cast("double") for x in c[3:]], strict=True)))
    assert each(spark, poor, ("1", "0", "0", "0", "0.6", "0"), ("0", "1", "0.8", "0.6", "0", "0"), ("0", "1", "0.7", "0.6", "0", "0"), (*["0.5"] * 3, *["0.9"] * 3), (None,) * 6) == [True, True, False, False, False]


def test_state_counts(spark):
    rows = spark.createDataFrame([(s,) for s in ("queued", "parsing", "retrying", "failed", "partial_failed", "ready", "unknown", None)], "status string")
    assert tuple(rows.agg(*analytics.state_counts(F.col("status"))).first()) == (3, 1, 2, 1)
    assert tuple(rows.limit(0).agg(*analytics.state_counts(F.col("status"))).first()) == (0, 0, 0, 0)
