import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.functions import exprs as X
from furrow.functions import special as SP


def one(spark, column, *values, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).coalesce(1).select(column).collect()]


def test_numbers(spark):
    assert one(spark, X.parse_number("x"), "1.5", "1,5", "1.234,5", "-2e3", "-", "nan", "None", "", None, "1.234.567", "1,234", " 7 ", "x") == [1.5, 1.5, 1234.5, -2000.0, None, None, None, None, None, None, 1.234, 7.0, None]


def test_text_and_states(spark):
    assert one(spark, X.text_key("x"), "  Ação\t Ç ", None) == ["acao c", ""]
    assert one(spark, X.machine_state("x"), "Em OPERAÇÃO", "manobra", "Deslocamento", "Abastecendo", "Parada", "?", None) == ["operation", "maneuver", "transit", "supply", "stop", "other", "other"]
    assert one(spark, X.filename_date("x"), "s_2025-11-01.tiff", "s_2025-13-01.tiff", "s.tiff") == [dt.date(2025, 11, 1), None, None]
    assert one(spark, X.strip_zone("x"), "01/02/2025 - 10:00 / GMT -3") == ["01/02/2025 - 10:00"]
    assert one(spark, X.pipe_list("x"), "a | b|a||c") == [["a", "b", "c"]]
    assert one(spark, X.truthy("x"), "TRUE", "sim", "1", "0", None) == [True, True, True, False, False]
    assert one(spark, X.redact_paths("x"), "/home/me/f") == ["/home/<user>/f"]


def test_numbers_are_written_as_printf_does(spark):
    values = [0.5, 1.5, 2.5, 5001508.5, 0.25, 0.35, -0.4, 1e15, 0.0005, -2.675, 0.0, 0.05, 0.005, -0.0005, 0.15, 0.0015, 1.005, 12.345]
    for digits in (0, 1, 2, 3):
        assert one(spark, X.fixed("x", digits), *values, None, schema="x double") == [*[f"{v:.{digits}f}" for v in values], None]
        assert one(spark, X.fixed("x", digits, signed=True), *values, schema="x double") == [f"{v:+.{digits}f}" for v in values]


def test_detections(spark):
    nested = '["[]", "[{\\"name\\":\\"Spodoptera spp.\\",\\"confidence\\":0.9}]"]'
    found = one(spark, F.transform(X.detections("x"), lambda r: r["name"]), nested, '[{"name":"a"},{"name":"b"}]', "bad", None, "[]")
    assert found == [["Spodoptera spp."], ["a", "b"], [], [], []]


def test_guards(spark):
    assert one(spark, X.clip01(F.col("x")), -1.0, 0.4, 2.0, None, schema="x double") == [0.0, 0.4, 1.0, 1.0]
    labels = X.top_labels([(F.col("x") > 0, 1.0, "b"), (F.col("x") > 1, 1.0, "a"), (F.lit(None).cast("boolean"), 9.0, "n"), (F.col("x") > 0, 2.0, "c"), (F.col("x") > 0, 0.5, "d")])
    assert one(spark, labels, 2, 1, 0, schema="x int") == [["c", "a", "b"], ["c", "b", "d"], []]


@pytest.mark.parametrize("t,df,p", [(12.706, 1, 0.05), (2.228, 10, 0.05), (1.96, 1e7, 0.05), (0.0, 5, 1.0)])
def test_t_tail(t, df, p):
    assert abs(SP.t_two_sided(t, df) - p) < 2e-4


def test_small_sample_tests():
    assert SP.ttest_p(np.zeros(4)) == 1.0 and SP.ttest_p(np.ones(4)) == 0.0 and SP.ttest_p(np.ones(1)) is None
    # exact signed-rank: all of five values positive
    assert SP.wilcoxon_p(np.array([1.0, 2, 3, 4, 5])) == pytest.approx(2 / 32)
    assert SP.wilcoxon_p(np.zeros(3)) == 1.0 and SP.wilcoxon_p(np.array([1.0])) is None
    # published example of eleven weights: W = 0.79, p about 0.007
    weights = np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236.0])
    assert SP.shapiro_p(weights) == pytest.approx(0.0067, abs=5e-4)
    assert SP.shapiro_p(np.random.default_rng(0).normal(size=200)) > 0.01
    assert SP.shapiro_p(np.random.default_rng(0).exponential(size=200)) < 1e-6
    assert SP.shapiro_p(np.ones(5)) is None
    assert SP.correlation_p(0.5, 20) == pytest.approx(0.0248, abs=3e-4)


def test_resampling_is_seeded():
    v = np.linspace(-0.1, 0.4, 12)
    assert SP.bootstrap_ci(v) == SP.bootstrap_ci(v)
    low, high = SP.bootstrap_ci(v)
    assert low < v.mean() < high
    assert SP.sign_flip_p(np.full(10, 0.2)) < 0.01 and SP.sign_flip_p(np.array([0.1, -0.1])) == 1.0


def test_text_keys_fold_all_accents_and_tokens_split(spark):
    import unicodedata

    words = ["Ångström", "ČŠŽ Řeka", "ŁódŹ", "Ἀθῆναι", "Йогурт", "e\u0301te\u0301  x", "Việt NAM", "ǅ ﬁ ß", "  a \t b "]

    def plain(text):
        return " ".join("".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c)).split())

    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(X.text_key("w")).collect()]
    same = [i for i, w in enumerate(words) if "ﬁ" not in w]  # letters that decompose into several stay
    assert [got[i] for i in same] == [plain(words[i]) for i in same]
    assert spark.createDataFrame([("a + b,c;; d/ e",)], "w string").select(X.token_list("w")).first()[0] == ["a", "b", "c", "d", "e"]
