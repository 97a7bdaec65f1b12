import hashlib
import unicodedata
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from docloom.functions import text as T


def one(spark, value, *columns):
    return tuple(spark.createDataFrame([(value,)], "x string").select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_white_space(spark):
    x = F.col("x")
    assert one(spark, "   a　b\n\tc \r\n", T.strip_space(x), T.squeeze(x)) == ("a　b\n\tc", "a b c")
    assert one(spark, None, T.normalize(x)) == ("",)


def test_folding_keeps_lengths(spark):
    s = "Đặng Thị Ánh ở thành phố Huế; Straße"
    (got,) = one(spark, s, T.strip_accents(F.col("x")))
    assert got == "Dang Thi Anh o thanh pho Hue; Straße" and len(got) == len(s)
    assert one(spark, "Xã Tân-Lập, TP. Huế", T.fold_place(F.col("x"))) == ("xa tan lap tp hue",)


def test_accent_table_is_that_of_unicode():
    for a, b in zip(T.ACCENTED, T.PLAIN):
        if a not in "đĐ":
            assert "".join(c for c in unicodedata.normalize("NFD", a) if not unicodedata.combining(c)) == b


def test_markers(spark):
    x = F.col("x")
    assert [one(spark, v, T.marker_value(x))[0] for v in ("A", "Th 2", "NLQ 12", "N.V.A", "a", "XIV", "H0", "", "ABC")] == ["A", "Th2", "NLQ12", "N.V.A", None, "XIV", None, None, None]
    assert one(spark, "H150", T.marker_family(x), T.number_suffix(x), T.numeric_suffix(x)) == ("H", "150", 150)
    assert one(spark, "đường Đ", T.initial_letter(x)) == ("Đ",) and one(spark, "ánh", T.initial_letter(x)) == ("A",)
    assert one(spark, "x" + "9" * 60, T.numeric_suffix(x)) == (None,)


def test_stable_hash(spark):
    want = hashlib.sha256("42\x1fa\x1f7".encode()).hexdigest()
    got = one(spark, "a", T.stable_hash("42", F.col("x"), F.lit(7)), T.stable_u64("42", F.col("x"), F.lit(7)), T.stable_slot(97, "42", F.col("x"), F.lit(7)))
    assert got == (want, int(want[:16], 16), int(want[:16], 16) % 97)


@pytest.mark.parametrize("start,end", [(0, 1), (1, 4), (5, 6), (0, 7)])
def test_context_with_astral_characters(spark, start, end):
    s = "😀bc défg"[:7]
    (got,) = one(spark, s, T.marked_context(F.col("x"), F.lit(start), F.lit(end), 3))
    assert got == s[max(0, start - 3) : start] + "[MENTION]" + s[start:end] + "[/MENTION]" + s[end : end + 3]
    parts = one(spark, got, T.split_context(F.col("x")))[0]
    assert parts["mention"] == s[start:end]


def test_jaccard_and_html(spark):
    a, b = F.array(F.lit("x"), F.lit("y")), F.array(F.lit("y"))
    assert one(spark, "", T.jaccard(a, b), T.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == (0.5, 0.0)
    assert one(spark, "<b>[MENTION]x[/MENTION]", T.highlight(F.col("x"))) == ("&lt;b&gt;<mark>x</mark>",)
    assert one(spark, "<script>1<2</script><p>a <b>b</b></p><!-- c -->", T.text_only(F.col("x"))) == ("a b",)


def test_ratio_bounds(spark):
    rows = spark.createDataFrame([(Decimal(u),) for u in (0, 2**64 - 1, 1844674407370955161, 1844674407370955162)], "u decimal(20,0)")
    assert [r[0] for r in rows.select(T.below_ratio(F.col("u"), 0.1)).collect()] == [True, False, True, False]
