"""Named encodings: what is named, what is never guessed, and the checks of what isn't named."""

import pytest

from corpusloom.functions import nominate
from corpusloom.functions.decode import LEGACY, decode_files, ladder, validated

TEXTS = {
    "gbk": ["这是一个简单的中文句子,用来说明我们怎样认识文字。", "今天天气很好,我们去公园里走一走,然后回家吃饭。", "世界上有许多国家,每个国家都有自己的语言和历史。", "你好,请问这里离车站还有多远?", "学习一门新的语言需要时间和耐心。"],
    "big5": ["這是一個簡單的中文句子,用來說明我們怎樣認識文字。", "今天天氣很好,我們去公園裡走一走,然後回家吃飯。", "世界上有許多國家,每個國家都有自己的語言和歷史。", "你好,請問這裡離車站還有多遠?", "學習一門新的語言需要時間和耐心。"],
    "shift_jis": ["これは文字を見分けるための簡単な日本語の文です。", "今日は天気がいいので、公園を散歩してから家に帰ります。", "世界には多くの国があり、それぞれの言葉と歴史があります。", "すみません、駅までどのくらいかかりますか。", "新しい言葉を学ぶには時間がかかります。"],
    "euc-kr": ["이것은 글자를 알아보기 위한 간단한 한국어 문장입니다.", "오늘은 날씨가 좋아서 공원을 걷고 나서 집에 돌아갑니다.", "세계에는 많은 나라가 있고 저마다의 말과 역사가 있습니다.", "실례합니다, 역까지 얼마나 걸립니까?", "새로운 말을 배우려면 시간이 필요합니다."],
    "windows-1252": ["L'été dernier, nous avons visité des châteaux près de la forêt où naît la rivière.", "Die Straße führt über große Brücken zu den schönen Häusern.", "El niño pequeño soñó con montañas y mañanas frías.", "À bientôt, j'espère; ça va être très agréable.", "Überall gibt es süße Äpfel und grüne Bäume."],
}
UNSEEN = {
    "gbk": "我们需要学习语言,这个世界的历史很长,今天请你说一说自己的国家。" * 2,
    "big5": "我們需要學習語言,這個世界的歷史很長,今天請你說一說自己的國家。" * 2,
    "shift_jis": "言葉を学ぶのは簡単ではありませんが、時間をかけて公園で文字を見ます。" * 2,
    "euc-kr": "말을 배우는 것은 간단하지 않습니다. 오늘 공원에서 글자를 알아봅니다." * 2,
    "windows-1252": "Près du château, la rivière gelée brillait; où étaient passés les élèves? " * 6,
}


@pytest.fixture(scope="module")
def nominator(spark):
    return nominate.fitted(spark.createDataFrame([(t,) for ts in TEXTS.values() for t in ts] + [(None,), ("ascii",)], "text string"))


@pytest.mark.parametrize("label", list(LEGACY))
def test_unseen_texts_are_named_and_read(nominator, label):
    data = UNSEEN[label].encode(LEGACY[label])
    d = ladder(data, nominator)
    assert (d.kind, d.encoding, d.text) == ("text", label, UNSEEN[label])
    # without a nominator nothing is guessed
    assert (ladder(data).kind, ladder(data).reason) == ("rejected", "ambiguous")


def test_little_evidence_is_never_guessed(nominator):
    for label, text in UNSEEN.items():
        for n in range(1, len(text)):
            data = text[:n].encode(LEGACY[label])
            if sum(b > 127 for b in data) >= nominate.EVIDENCE:
                break
            assert ladder(data, nominator).kind == "rejected" or data.isascii()
        else:
            raise AssertionError("the text has too little evidence")


def test_bytes_that_no_language_has(nominator):
    noise = bytes([0xC1, 0xC0] * 40)
    assert ladder(noise, nominator).kind == "rejected"
    assert nominate.Nominator({x: nominate.np.zeros(nominate.PAIRS) for x in LEGACY}).nominate(noise * 3) is None


def test_checks_of_what_is_not_named():
    # a character of two bytes that a segment's end cuts: fine when named, not otherwise
    data = b"a" + "世界".encode("gbk") * 2048
    assert validated(data, "gbk", True) and validated(data, "gbk") is None
    assert validated(b"aa" + data[1:], "gbk") is None or len(data) % 2
    assert validated("世界".encode("gbk") * 2048, "gbk")
    # a single byte encoding is checked either way: control characters, and bytes it hasn't got
    assert validated(b"caf\xe9", "cp1252", True) == "café"
    assert validated(b"caf\xe9\x81", "cp1252", True) is None and validated(b"\xe9\x01", "cp1252", True) is None


def test_files_in_a_plan(spark, nominator):
    rows = [(label, UNSEEN[label].encode(LEGACY[label])) for label in LEGACY] + [("plain", b"plain"), ("empty", b""), ("none", None), ("nul", b"\0")]
    out = {r.rel: r for r in decode_files(spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in rows], "rel string, content binary"), nominator=nominator).collect()}
    assert all(out[label].text == UNSEEN[label] and out[label].encoding == label for label in LEGACY)
    assert (out["plain"].encoding, out["empty"].text, out["none"].kind, out["nul"].kind) == ("utf-8", "", "rejected", "binary")
