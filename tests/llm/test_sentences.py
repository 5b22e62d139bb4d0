import random

import pytest
from pyspark.sql import functions as F

from pathloom.llm.sentences import sentences, starts

CASES = [
    "The desk closed the ticket.|Dept. 4 signed the change on Jan. 5.|We compared both views.",
    "The exchange in the U.S. is 28.7 ms away from rs8.pop5.example.|It was approved at 9 a.m. by the desk.",
    "They ended at 3 p.m.|A customer of AS10 left.|It is run by Transit Inc.|Do not touch it!",
    "See sec. 7.19 of the runbook, e.g. the part on 10.243.132.0/24.|17 of the 83 paths were new.",
    "The path went AS1011674... and then nowhere.|We waited for AS9...|The duty desk left.",
    '"Is 10.2.3.0/24 back?" asked the desk of AS1.|It read: "Clear the table. Then wait."|We left.',
    '"We lost AS1. Nothing else moved," the shift note said.|(No. 16 in the list of peers was left out.)|All sessions were up again.',
    "iBGP was not affected.|eBGP timers were lowered.|Really?!|Release v4.4.7 fixed this.",
    "Der Wechsel begann am 3.|Die Störung ist behoben.|Am 3. März wurde der Filter ersetzt.|Das betrifft z. B. 10.1.0.0/16 und d. h. AS1.",
    "„Wir sehen AS1 nicht mehr. Bitte prüfen“, schrieb die Leitstelle.|Rund 10.000 Routen fehlten, ca. 32,9 Prozent.",
    "Hubo fugas, saltos, etc.|El enlace con EE. UU. tiene 7,9 ms.|¿Por qué falta 10.1.0.0/16?|«Se cayó. Nada más cambió», anotó la guardia.",
    "Ne touchez pas à rs8.pop2.example !|Pourquoi AS1 annonce-t-il 10.1.0.0/16 ?|Il reste env. 3657 routes, p. ex. 10.1.0.0/16.",
    "Были утечки, сбросы и т. д.|Это, т. е. утечка, длилась 2 мин. подряд.|См. рис. 18 и п. 18 инструкции.",
    "上游AS10误过滤了10.199.49.0/24，但没有告警。|版本9.15.5已修复……不过还要再看。|真的吗？！|“AS1断了。其他正常。”值班记录写道。|一切恢复正常。",
    "対応は終わった。|損失は22.7％である（図3を参照。）|edge7.pop2.exampleには触れないこと！|「AS1が落ちた。他は正常だ。」と当直は記した。",
    "ทำไมเส้นทาง 10.1.0.0/16 จึงหายไป|งานนี้เสร็จแล้ว|ทีมเวรบันทึกว่าเส้นทาง 10.2.0.0/16 หายไปนาน",
    'सीमा 34.6 है, अर्थात् अधिक।|डॉ. शाखा का नियम क्र. 8 देखें।|सत्र बंद हुआ ।|"AS1 नहीं दिख रहा। बाकी ठीक है," दल ने लिखा।|core9.pop9.example को मत छुओ!|rs1.pop1.example को मत छुओ!',
    'الحد هو 0.6؛ وكان من قبل 6.5.|كتب الفريق: "فقدنا AS1. لم يتغير شيء آخر."|لماذا اختفت 10.2.0.0/16؟|عاد كل شيء.',
]


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("sentence", F.lit("clash"))
    out = {}
    for r in sentences(df, "doc_id", "text").collect():
        text = texts[r.doc_id][r.start_pos : r.end_pos]
        assert text == r.sentence and text == text.strip()
        out.setdefault(r.doc_id, []).append((r.start_pos, text))
    return [[t for _, t in sorted(out.get(i, []))] for i in range(len(texts))]


def test_languages(spark):
    texts = [c.replace("|", "" if "。" in c and "，" in c or "対応" in c else " ") for c in CASES]
    got = found(spark, texts)
    assert got == [c.split("|") for c in CASES]


def test_blanks_left_out(spark):
    assert found(spark, ["The limit was reached.The desk closed it.Why?Nobody knows.", "ولم يصدر أي تنبيه.الموجه عاد."]) == [["The limit was reached.", "The desk closed it.", "Why?", "Nobody knows."], ["ولم يصدر أي تنبيه.", "الموجه عاد."]]


def test_urls_paths_and_dotted_names_stay_whole(spark):
    cases = [
        "See https://host.example/a?Query=1 for the log.|Visit http://a.b/C.D.|Then go.", "Node.JS is used.|See /etc/Foo.Bar now.",
        "Ask e.g. Smith.|It took 5 h.|Then it ended.", "See Plan B.|Then stop.|J. Smith left.", "The 2. Bundesliga ended.|See rev. 4 and cap. 3 there.",
        "It (see 3. The log. Also) ended.|He said “stop (at 5. Now).” twice.|Done", "Das sind z.B. AS1 und z. B. AS2, i. d. R. AS3.|Ende.",
    ]
    assert found(spark, [c.replace("|", " ") for c in cases]) == [c.split("|") for c in cases]


def test_blanks_of_any_kind(spark):
    cases = ["It ended.\xa0The desk left.", "Tout est clos.\u202f« Rien. Rien », a noté la garde.", "Fermé. « Oui. Non », dit-il.", "हो गया।\xa0ठीक है!\u3000सब ठीक।", "Wirklich?\u2003Ja."]
    want = [["It ended.", "The desk left."], ["Tout est clos.", "« Rien. Rien », a noté la garde."], ["Fermé.", "« Oui. Non », dit-il."], ["हो गया।", "ठीक है!", "सब ठीक।"], ["Wirklich?", "Ja."]]
    assert found(spark, cases) == want


def test_lines_items_entries_and_rulings(spark):
    text = "Summary\n\n10.17 Findings\r\n\r\nA line that\nwraps here. Next one\nends.\n------\n1. First item. Second sentence\n2. Item\n   goes on\n- dash\n* star\n\n[09:37:41] An entry\n2025-07-22T07:51Z core7 went. Down\n1751292287 rrc91: last\n====\n-- NOC desk 13"
    assert found(spark, [text]) == [["Summary", "10.17 Findings", "A line that\nwraps here.", "Next one\nends.", "1. First item.", "Second sentence", "2. Item\n   goes on", "- dash", "* star", "[09:37:41] An entry", "2025-07-22T07:51Z core7 went.", "Down", "1751292287 rrc91: last", "-- NOC desk 13"]]


def test_a_wrapped_number_is_no_item(spark):
    assert found(spark, ["The change, signed by them\n3) and others."]) == [["The change, signed by them\n3) and others."]]
    assert found(spark, ["We met them on Jan.\n5. We then left."])[0][-1] == "We then left."


def test_nothing_and_odd_texts(spark):
    odd = ["", None, " \n\t\u00a0", "....", "---\n***", "\ue000 is \ue001 kept. So \ue00d \ue00e too", "a\rb\u2028c. D", "No end mark", "x" * 200_000, "Word. " * 20_000, "\n" * 50_000 + "End", '"' * 999 + " a. B", "“" * 3000 + "a. B"]
    texts = [t if t is not None else "" for t in odd]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id int, text string")
    out = {}
    for r in sentences(df, "doc_id", "text").collect():
        assert texts[r.doc_id][r.start_pos : r.end_pos] == r.sentence
        out.setdefault(r.doc_id, []).append(r.sentence)
    assert set(out) == {5, 6, 7, 8, 9, 10, 11, 12} and len(out[9]) == 20_000 and out[7] == ["No end mark"] and len(out[5]) == 2
    assert sentences(df.limit(0), "doc_id", "text").count() == 0


def test_every_letter_and_digit_is_in_one_sentence(spark):
    rng = random.Random(6)
    tokens = ["The", "desk", "AS10", ".", "!", "?", "。", "।", "3.5", "(", ")", '"', "“", "”", "\n", "\n\n", " ", " ", "- a", "1. b", "Nr.", "หาย", "شيء", "終", "[09:37:41] x", "🙂", "…"]
    texts = ["".join(rng.choices(tokens, k=rng.randrange(60))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    spans = {}
    for r in sentences(df, "doc_id", "text").collect():
        assert texts[r.doc_id][r.start_pos : r.end_pos] == r.sentence
        spans.setdefault(r.doc_id, []).append((r.start_pos, r.end_pos))
    for i, text in enumerate(texts):
        ordered = sorted(spans.get(i, []))
        assert all(a[1] <= b[0] for a, b in zip(ordered, ordered[1:]))
        covered = {p for a, b in ordered for p in range(a, b)}
        assert not [c for p, c in enumerate(text) if c.isalnum() and p not in covered]


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
def test_starts(spark, n):
    values = [i % 7 for i in range(n)]
    got = spark.createDataFrame([(values,)], "a array<int>").select(starts(F.col("a")).alias("s")).first().s
    assert got == [sum(values[:i]) for i in range(n)]
