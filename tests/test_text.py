from pyspark.sql import functions as F

from lodestone.functions import masking as M
from lodestone.functions import text as T


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{c} string" for c in cols))
    return df.select(expr.alias("x")).first()["x"]


def test_tokens_and_singulars(spark):
    assert one(spark, T.tokenize(F.col("t")), t="Processes classes bus has is Forms 12s") == ["processe", "classe", "bus", "has", "is", "form", "12s"]
    assert one(spark, T.tokenize(F.col("t")), t=None) == []


def test_codes(spark):
    t = "see f - p - cm - 01 - 2, F‐P‐CM‐01‐2 and F-M-HR-03-01 of P-CM-01; M-HR-08"
    assert one(spark, T.form_codes(F.col("t")), t=t) == ["F-P-CM-01-2", "F-M-HR-03-01"]
    cited = F.array(F.lit("F-P-CM-01-2"))
    assert one(spark, T.uncited_doc_codes(F.col("t"), cited), t="F-P-CM-01-2 P-CM-01 M-HR-08") == ["M-HR-03", "M-HR-08"][1:]


def test_families(spark):
    for code, name, want in (("P-CM-01", "x", "PCM"), ("", "PVMO02_x.pdf", "PVMO"), ("F-P-TN-02", None, "PTN"), (None, "diagram.pdf", None)):
        assert one(spark, T.doc_family(F.col("c"), F.col("f")), c=code, f=name) == want
    assert one(spark, T.route_families(F.col("q")), q="compare P-TN-02 with F-P-CM-01 and p-tn-03") == ["PCM", "PTN"]
    assert one(spark, T.hinted_families(F.col("q")), q="the vendor survey") == ["PCM", "PVMO"]
    assert one(spark, T.workflow_intent(F.col("q")), q="Who SIGNS after the director?") is True


def test_language_and_quality(spark):
    for t, want in (("hello world", False), ("ما هو النموذج", True), ("ما P-CM-01", True), ("123 !!", False), ("hello ؟؟", False), ("hello world ٣٤٥", False), ("؟؟", False)):
        assert one(spark, T.is_arabic(F.col("t")), t=t) is want
    for t, want in (("A page of ordinary text, long enough.", True), ("short", False), ("1234567890 1234567890 ab", False), (None, False)):
        assert one(spark, T.text_quality_ok(F.col("t")), t=t) is want


def test_answers(spark):
    assert one(spark, T.strip_reasoning(F.col("t")), t="<think>a\nb</think> yes <THINK>no") == "yes"
    assert one(spark, T.summarize(F.col("t")), t="First  one.\nSecond one.") == "First one."
    assert one(spark, T.refused(F.col("t")), t="That is NOT specified.") is True
    assert one(spark, T.amounts(F.col("t")), t="Over 500 K, 500k or 3M; 1,000 LE") == ["500K", "3M", "1,000LE"]
    assert one(spark, T.is_loop(F.col("t")), t="Not Approved") is True
    assert one(spark, T.normal_filename(F.col("t")), t="P-CM-01 Customer Satisfaction Process (1).pdf") == "PCM01_Customer_Satisfaction_Process_1.pdf"
    assert one(spark, T.normal_heading(F.col("t")), t=" 5.2. Process  Operations!") == "PROCESS OPERATIONS"
    r = one(spark, T.workflow_routes(F.col("t")), t="Routing:\n  - A -> B [over 3M]\n  - B -> C")
    assert [tuple(x) for x in r] == [("A", "B", "over 3M"), ("B", "C", None)]
    assert one(spark, T.target_tokens(F.col("t")), t="within 14 days, 2.5%") == ["14", "2.5%"]


def test_masking_round_trip(spark):
    text = "use F-P-CM-01-02 and p-tn-02"
    masked = one(spark, M.mask_codes(F.col("t")), t=text)
    assert tuple(masked) == ("use ZQ0ZQ and ZQ1ZQ", ["F-P-CM-01-02", "p-tn-02"])
    codes = F.array(*[F.lit(c) for c in masked.found])
    assert one(spark, M.unmask_codes(F.col("t"), codes), t=masked.masked) == text
    assert one(spark, M.unmask_codes(F.col("t"), codes), t="zq 1 zq only  ") == "p-tn-02 only (F-P-CM-01-02)"
    assert one(spark, M.unmask_codes(F.col("t"), codes), t="ZQ0ZQ, ZQ1ZQ, ZQ1ZQ, ZQ9ZQ and ZQ99999999999ZQ") == "F-P-CM-01-02, p-tn-02, p-tn-02, ZQ9ZQ and ZQ99999999999ZQ"
    arabic = "من يوقع بعد مدير المشروع في قسم المشتريات"
    masked = one(spark, M.mask_terms(F.col("t")), t=arabic)
    assert masked.found == ["PM", "Purchasing"] and "مدير المشروع" not in masked.masked
    assert one(spark, M.unmask_terms(F.col("t"), F.array(F.lit("PM"), F.lit("Purchasing"))), t="who   ") == "who (PM Purchasing)"
    # towards Arabic the preferred Arabic form is what comes back
    masked = one(spark, M.mask_terms(F.col("t"), english=True), t="the CMS, Commercial Dept. and CM")
    assert tuple(masked) == ("the CMS, GZ0GZ and GZ1GZ", ["قسم التجارة", "مدير الإنشاءات"])
    df = spark.createDataFrame([(text,), (None,)], "t string").withColumn("m", M.mask_codes(F.col("t")))
    assert [r[0] for r in df.select(M.unmask_codes(F.col("m.masked"), F.col("m.found"))).collect()] == [text, ""]


def test_translation(spark):
    from lodestone.operators.answering import translate

    for said, want in (("Translation: the form", "the form"), ("«the form»", "the form"), ("English text here", "English text here"), ('"a" and "b"', 'a" and "b'), (None, ""), ("'", "'")):
        assert one(spark, M.clean_translation(F.col("t")), t=said) == want
    hints = M.hint_block()
    assert all(x in hints for x in (*M.GLOSSARY, *M.AMBIGUOUS)) and hints.index("CEO") < hints.index("Tendering")

    def model(prompt):
        if "fail" in prompt:
            raise TimeoutError
        last = prompt.split("\n\n")[-1]
        return f'Translation: "{last[::1].replace("من", "who")}"' if "GZ0GZ" in last else "lost it all"

    rows = spark.createDataFrame([(1, "من مدير المشروع F-P-CM-01-02"), (2, "P-CM-01 بعد"), (3, "fail")], "id int, text string")
    got = {r.id: (r.translated, r.error_type) for r in translate(rows, model, to_english=True).collect()}
    assert got == {1: ("who PM F-P-CM-01-02", None), 2: ("lost it all (P-CM-01)", None), 3: ("fail", "timeout")}
    back = translate(spark.createDataFrame([("ask the PM about P-CM-01",)], "text string"), lambda p: p.split("\n\n")[-1], to_english=False).first()
    assert back.translated == "ask the مدير المشروع about P-CM-01"


def test_names(spark):
    assert one(spark, T.display_name(F.col("t")), t="PCN01_Subcontract_Form.PDF") == "P-CN-01 Subcontract Form"
    assert one(spark, T.display_name(F.col("t")), t="Bonds Request - WF.pdf") == "Bonds Request - WF"
    assert one(spark, T.unique_slugs(F.array(*[F.lit(s) for s in ("a", "a", "a_2", "b", "a")])), t="") == ["a", "a_2", "a_2_2", "b", "a_3"]
