"""Golden vectors of the normalisation functions."""

import pytest
from pyspark.sql import functions as F

from linkweave.functions import fixed, keys, text, translit


@pytest.mark.parametrize("raw, latin", [("राम", "ram"), ("दिल्ली", "dilli"), ("कंपनी", "kanpani"), ("१२", "12"), ("ற்ற", "t"), ("Harris राम", "Hatis ram"), ("Harris", "Harris"), ("", "")])
def test_transliterate(raw, latin):
    assert translit.transliterate(raw) == latin


def test_every_class_is_used():
    assert {k for k, _ in translit.table().values()} == {"plain", "consonant", "sign", "mute", "skip"}


def test_skeletons_and_leet(spark):
    want = [("holloway", "lv", "holloway"), ("christ", "krst", "christ"), ("philips", "flps", "philips"), ("wagon", "vjn", "wagon"), ("box", "bks", "box"), ("aaa", "", "aaa"), ("101", "101", "101"), ("5ecure", "5kr", "secure"), ("1st", "1st", "lst"), ("2100", "2100", "2100")]
    df = spark.createDataFrame([(w[0],) for w in want], "w string")
    assert [tuple(r) for r in df.select("w", text.skeleton_word(F.col("w")), text.fix_leet(F.col("w"))).collect()] == want


def test_record_keys(spark):
    df = spark.createDataFrame([("pizza hut", ["pizzahut"], ["main", "st"], ["12"], 0, ["pizza hut"])], "a string, b array<string>, c array<string>, d array<string>, e int, f array<string>")
    found = df.select(keys.record_keys(*[F.col(c) for c in "abcdef"])).first()[0]
    want = "N:p t|k:p|k:t|b:p_t|i:ph|p:pizza|a:main|a:st|w:main_st|#:12|h:12_main|h:12_st|x:p_main|x:p_st|x:t_main|x:t_st"
    assert sorted(found) == sorted(want.split("|"))


def test_records_of_any_script(spark):
    rows = [("Pizza Hut, Inc.", "2100 Cameron Drive, Dundalk, MD"), ("राम कंपनी", "१२ दिल्ली"), (None, None), ("ﬁne Œuvre", "n°5 Rue de l'Été, Île de France")]
    df = spark.createDataFrame(rows, "business_name string, business_address string")
    found = text.delimited(text.normalize_records(df)).select("n_core", "n_skel", "a_norm", "a_nums", "a_words").collect()
    assert tuple(found[0]) == ("pizza hut", "pj t", "2100 cameron dr dundalk", "2100", "cameron dr dundalk")
    assert tuple(found[1]) == ("ram kanpani", "rm knpn", "12 dilli", "12", "dilli")
    assert tuple(found[2]) == ("", "", "", "", "")
    assert found[3]["n_core"].startswith("fine") and found[3]["a_norm"].startswith("5 rue")


def test_fixed_values():
    assert len(fixed.LEGAL) == len(set(fixed.LEGAL)) and len(fixed.FR_AREAS) == len(set(fixed.FR_AREAS))
    assert fixed.ordinals()["third"] == "3rd" and fixed.ordinals()["eleventh"] == "11th"
    assert fixed.address_canon()["street"] == "st" and fixed.address_canon()["centre"] == "ctr"
