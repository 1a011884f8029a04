import pytest
from pyspark.sql import functions as F

from scoreloom.functions import extract as ex

OPTIONS = {"A": "red cup", "B": "blue cup", "C": "green"}


def options():
    return F.create_map(*[F.lit(x) for kv in OPTIONS.items() for x in kv])


@pytest.mark.parametrize("s,expected", [
    ("B", "B"), ("The answer is (B).", "B"), ("A or B", None), ("Cannot determine the answer", "Z"), ("Z", "Z"), ("", None),
    ("Failed to obtain answer via API.", None), ("D", None), ("it is Green!", "C"), ("a cup", None), ("Z or A", "A")])
def test_infer(value, s, expected):
    assert value(lambda p: ex.infer(p, options()), s) == expected


@pytest.mark.parametrize("s,expected", [
    ("The order is BADC", "BADC"), ("AABC", None), ("first B, second A, third D, fourth C", "BADC"),
    ("step 1: C step 2: A step 3: D step 4: B", "CADB"), ("step 1: C step 2: C step 3: D step 4: B", None), ("no", None)])
def test_infer_sequence(value, s, expected):
    assert value(ex.infer_sequence, s) == expected


@pytest.mark.parametrize("s,expected", [
    ("final answer: **c**", "C"), ("I say **B.** yes", "B"), ("the answer is: d", "D"), ("maybe E. so", "E"), ("a", "A"),
    ("C because", "C"), ("either A or maybe C here", "C"), ("none", "INVALID")])
def test_choice_cascade(value, s, expected):
    assert value(ex.extract_choice_cascade, s) == expected


@pytest.mark.parametrize("s,expected", [
    ("The best answer is B", "B"), ("b", "B"), ("", "A"), ("one two three four five six seven eight nine ten eleven", ""), ("xyz", "")])
def test_extract_letter(value, s, expected):
    assert value(ex.extract_letter, s) == expected


def test_multi_choice_takes_the_last(value):
    read = lambda s: value(lambda p: ex.parse_choice_multi(p, options()), s)
    assert read("(A) is wrong, so (C)") == "C"
    assert read("I take B now") == "B"
    assert read("A. first") == "A"
    assert read("it could be the blue cup or even the red cup") == "A"
    assert read("no idea") is None


def test_numbers(value):
    assert value(ex.extract_numbers, "3 cups and two hundred five") == [3, 205]
    assert value(ex.first_count, "there are twenty one") == 20
    assert value(ex.first_count, "x 15 y") == 15
    assert value(ex.first_count, "many") is None
    assert value(ex.parse_quantity, "(2-4, cm)") == 3.0
    assert value(ex.parse_quantity, "two") == 0.0
    assert value(ex.parse_scalar_unit, "scalar{1 to 3} distance_unit{m}") == 200.0


def test_structures(value):
    assert value(ex.parse_score_pair, "8, 9\nwhy") == {"first": -1.0, "second": -1.0}
    assert value(ex.parse_score_pair, "8,9") == {"first": 8.0, "second": 9.0}
    assert value(ex.parse_score_json, "{'pred': 'Yes', 'score': 4}") == {"pred": "yes", "score": 4.0}
    assert value(ex.parse_score_json, "oops") == {"pred": None, "score": -1.0}
    assert value(ex.parse_verdict, "[[A>B]] then [[A>B]]") == "A>B"
    assert value(ex.parse_verdict, "[[A>B]] then [[B>A]]") is None
    assert value(ex.parse_qa_output, "question: Q one\nand\nANSWER: yes\nno") == {"question": "Q one\nand", "answer": "yes\nno"}
    assert value(ex.parse_bbox, "[0.1, .2, 1, 0.45]") == {"x1": 0.1, "y1": 0.2, "x2": 1.0, "y2": 0.45}
    assert value(ex.parse_bbox, "none")["x1"] is None
    assert value(ex.rows_columns, "Rows: {3} and Columns {4}") == "3,4"
    assert value(ex.rows_columns, "(3, 4)") == "3,4"
    assert value(ex.fenced_json_result, "x ```json\n{\"result\": B}\n``` y") == "B"
    assert value(ex.parse_answer_line, "so **Answer: 4** ok") == "4"
    # the capital of "Answer:" itself counts, so a second letter is needed to get the rest of the line
    assert value(ex.extract_cot_answer, "think\nAnswer: The red box") == " The red box"
    assert value(ex.extract_cot_answer, "think\nAnswer: a") == "A"
    assert value(ex.extract_cot_answer, "Answer: B\nAnswer: C") == "Answer: B\nAnswer: C"
    assert value(lambda s: ex.parse_by_type(s, F.lit("float")), "2π m")["value"].startswith("6.28")
    assert value(lambda s: ex.parse_by_type(s, F.lit("multiple choice")), "it is c") == {"ok": True, "value": "C"}


@pytest.mark.parametrize("s,kind,expected", [
    ("Yes and no", "yes_no", 1), ("no, yes", "yes_no", 0), ("B then a", "multiple_choice", 0), ("nobody", "yes_no", -1)])
def test_binary(value, s, kind, expected):
    assert value(ex.extract_binary, s, kind) == expected
