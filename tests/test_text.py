import re

import pytest
from pyspark.sql import functions as F

from scoreloom.functions import fixed
from scoreloom.functions import text as tx


def reference_punctuation(s):
    out = s
    for p in fixed.PUNCTUATION:
        out = out.replace(p, "" if p + " " in s or " " + p in s or re.search(r"\d,\d", s) else " ")
    return re.sub(r"(?<!\d)\.(?!\d)", "", out)


TEXTS = ["a,b", "1,000 cups; done", "end.", "3.14 is .5 or 5.", "x - y/z", "[a] {b}", "..5..a", "1..5", "", "!!", "don't (stop) it"]


@pytest.mark.parametrize("s", TEXTS)
def test_strip_punctuation(value, s):
    assert value(tx.strip_punctuation, s) == reference_punctuation(s)


@pytest.mark.parametrize("s,expected", [
    ("The Two dogs", "2 dogs"), ("dont run", "don't run"), ("a an the", ""), ("none of them", "0 of them"), ("TEN Theyre", "10 they're")])
def test_normalise_words(value, s, expected):
    assert value(tx.normalise_words, s) == expected


@pytest.mark.parametrize("s,expected", [
    (" $5 (USD) ", "5"), ("'Quoted'", "quoted"), ("12 %", "12"), ("Red (big) cup", "red cup")])
def test_clean_doc_string(value, s, expected):
    assert value(tx.clean_doc_string, s) == expected


def test_markdown_and_width(value):
    assert value(tx.clean_markdown, "a" + "-" * 15 + "b" + "_" * 9) == "a----b____"
    assert value(tx.clean_markdown, "```markdown\n# x\n```") == "# x\n"
    assert value(tx.fullwidth_to_halfwidth, "Ａ（１）　、") == "A(1) ,"
    assert value(tx.remove_spaces, "图 中 有 red5 苹 果") == "图中有red 5苹果"
    assert value(tx.clean_string, "a\\tb 中-文_1") == "ab中文_1"


def test_ocr_tokens(value):
    assert value(lambda s: tx.ocr_tokens(s), "A  b\t### C") == ["a", "b", "c"]
    assert value(lambda s: tx.ocr_tokens(s, by_word=False), "a b") == ["a", "b"]
    assert value(lambda s: tx.ocr_tokens(s, alnum=True), "a! --") == ["a"]


@pytest.mark.parametrize("option,expected", [("A", True), ("Both", True), ("A and B", True), ("Stage C", True), ("a dog", False), ("", True)])
def test_reads_as_letters(value, option, expected):
    assert value(tx.reads_as_letters, option) is expected


def test_numbers(value):
    assert [value(tx.as_float, s) for s in ("1.5", " 2 ", "x", "1e3", "")] == [1.5, 2.0, None, 1000.0, None]


def test_judge_prompt_forms(value):
    examples = {"en_single": [dict(question="Q", answer="A", prediction="P", correctness="yes", reason="R")], "en_multi": [], "cn_multi": [
        dict(question="问", answer="答", prediction="测", correctness="no", reason="因")]}
    ask = lambda question, answer, kind=None: value(
        lambda x, a, p, k: tx.prompt_judge(x, a, p, examples, k.cast("string")), question, answer, "said", kind)
    head = "Question: Q\nGround truth: A\nPrediction: P\nVerdict: yes\nReason: R\n\n"
    single = head + "Question: what?\nGround truth: {}\nPrediction: said\nIs the prediction right? Reply yes or no."
    assert ask("what?", "red") == single.format("red")
    assert ask("what?", "['red']") == single.format("red")
    assert ask("what?", "[]") == single.format("[]")
    assert ask("what?", "[red") == single.format("[red")
    assert ask("what?", "['red', 'blue']", "exactMatch") == single.format("['red', 'blue']")
    many = ask("what?", "['red', 'it\\'s \"blue\"']", "listofstr")
    assert many.startswith("Question: what?\nGround truth: [\"red\",\"it's \\\"blue\\\"\"]\nPrediction: said\nThe ground truth is a list")
    assert ask("什么？", '["红", "蓝"]').startswith('问题：问\n标准答案：答\n预测：测\n判断：no\n理由：因\n\n问题：什么？\n标准答案：["红","蓝"]\n预测：said\n标准答案是一个列表')
    assert ask("什么？", "红") == "问题：什么？\n标准答案：红\n预测：said\n预测正确吗？请回答 yes 或 no。"
    assert value(lambda x, p: tx.prompt_judge(x, F.lit(None).cast("string"), p), "what?", "said") is None
