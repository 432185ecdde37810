import re

from pyspark.sql import functions as F

from passagework.functions import text as T


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t")).alias("o")).first().o


def test_clean_extracted_text_order(spark):
    raw = "  a manage-\r\nment ﬁne  x \t\n\n\n\nb-\nB\r"
    assert one(spark, raw, T.clean_extracted_text) == "a management fine x\n\nb-\nB"


def test_dot_leaders_keep_decimals(spark):
    assert one(spark, "6.5 and 1.5.9 ..... 9", T.remove_dot_leaders) == "6.5 and 1.5.9   9"


def test_fold_punctuation(spark):
    assert one(spark, "self‑monitoring “1–3”\n months’", T.fold_punctuation) == "self-monitoring \"1-3\" months'"


def test_strip_knows_every_white_space(spark):
    value = " \x1c\xa0 a b 　\n"
    assert one(spark, value, T.strip) == value.strip() == "a b"


def test_content_words_drop_stop_words(spark):
    assert sorted(one(spark, "What should the Dose be? dose of XR", T.content_words)) == ["dose"]


def test_line_shapes(spark):
    lines = ["1.2.3", "41", "Page 41 of", "page 4 of 131", "12 of 131", "12345", "Dose"]
    got = [one(spark, x, T.line_shape) for x in lines]
    assert got == ["protected", "page_number", "page_number", "page_number", "page_number", "text", "text"]


def test_toc_ratio_needs_eight_lines(spark):
    assert one(spark, "\n".join(["Topic 3"] * 7), T.toc_line_ratio) == 0.0
    assert one(spark, "\n".join(["Topic 3"] * 4 + ["text"] * 4), T.toc_line_ratio) == 0.5


def test_titled_lines(spark):
    cases = {"Care Plan Review": True, "The blood glucose protocol is": False, "ALL CAPS": True, "Diagnosis": False}
    for line, want in cases.items():
        assert one(spark, line, T.looks_titled) is want


def test_boilerplate_headings(spark):
    for line, want in {"131\nContents": True, "Page 3 of": True, "© Someone": True, "1.2 Care": False}.items():
        assert one(spark, line, T.is_boilerplate_heading) is want


def test_intents(spark):
    cases = {
        "I want to book an appointment": "book", "please reschedule it": "reschedule", "cancel my visit": "cancel",
        "which doctors can see me": "availability", "when is my appointment": "appointment", "I have a headache": "medical",
        "Hello!!": "greeting"}
    for text, want in cases.items():
        assert one(spark, text, T.classify_intent) == want


def test_personal_requests(spark):
    assert one(spark, "Do I have\n diabetes?", T.personal_request) == "patient_specific_diagnosis"
    assert one(spark, "How much should I take of this medicine", T.personal_request) == "patient_specific_dosage_or_treatment"
    assert one(spark, "What is the usual starting range of metformin?", T.personal_request) is None


def test_off_topic(spark):
    assert one(spark, "oil   filter for my Toyota", T.clearly_off_topic) is True
    assert one(spark, "carotid stenosis", T.clearly_off_topic) is False


def test_quote_head_cuts_on_a_word(spark):
    text = "word " * 200
    got = one(spark, text, T.quote_head)
    want = " ".join(text.split())[:420].rsplit(" ", 1)[0]
    assert got == want and len(got) <= 420


def test_sentences(spark):
    text = "One. Two!  Three? 3.5 mg.\nFour"
    assert one(spark, text, T.sentences) == re.split(r"(?<=[.!?])\s+", text)
