import pytest

from strandline.llm import sentences as S

# Each case lists the sentences; the text is what they make when joined by the separator.
CASES = [
    (" ", ["Dr. Bax from next door agrees.", "It weighs approx. 1.73 kg, i.e. less!", "See sec. 5.8 for more…", "Ask for T. J. Fen at the desk."]),
    (" ", ["Delivery was promised by 3 p.m.", "It came with clips, a cloth, etc.", "U.S. plugs fit, but the E.U. adapter costs 28.55 more.", "(It was a gift.)", "The box (it was soaked!) held two parts."]),
    (" ", ["“Will it last? I doubt it.” was my first thought.", 'She wrote "It ships today. No worries." and went silent.', 'He said "Best lamp ever!" 🎉🎉', "They charge .195 per page, vs. 73.2 before."]),
    ("", ["It needs a longer cable!", "Poor lamp, would not buy again.", "The part is odd?!", "The manual at help.site.example lists 9 steps."]),
    (" ", ["I waited... and waited... and then it came.", "Firmware v2.10.3 fixed it.", "I ordered No. 50, not No. 155.", "They left."]),
    (" ", ["Das gilt z. B. für Nr. 3 und Nr. 4.", "Auf S. 4 steht nichts, vgl. Abb. 5.", "Geliefert am 9. Mai, bestellt am 5. April.", "Der Händler schrieb „Kommt heute. Versprochen.“ und schwieg.", "Meine Tochter rief „Endlich!“", "Kabel, Schrauben usw.", "Gut."]),
    (" ", ["Le vendeur a écrit « Ça part ce soir. Promis. » puis plus rien.", "M. Korx et Mme Lum ont la même veste !", "Voir p. 38 et fig. 2."]),
    (" ", ["El Sr. Nal y la Sra. Lum tienen una.", "¿Alguien probó el modo?", "¡Muy suave!", "Hay otras, p. ej. la n.º 6, que son ligera."]),
    (" ", ["Πού μπαίνει το κουμπί lum;", "Υπάρχουν κι άλλες, π.χ. η γερή.", "Κοστίζει 24,23 ευρώ· πριν 30,7."]),
    (" ", ["قال البائع «سنرسله اليوم. لا تقلق.» ثم سكت.", "يقول د. تورفا إن المصباح قوي.", "هل جرب أحد؟", "الثمن ٤٫٥ أو 44.9 دينار."]),
    (" ", ['दुकानदार ने कहा "आज भेजेंगे। चिंता मत करो।" और फिर चुप रहा।', "डॉ. तोरवा के पास है।", "दाम रु. 235 था!", "क्या किसी ने चलाया है?"]),
    (" ", ['ร้านบอกว่า "ส่งวันนี้ครับ ไม่ต้องห่วงครับ" แล้วก็เงียบไปครับ', "ขนาด 7 ซม. x 209 ซม. วางได้ค่ะ", "รุ่น gul 1.7 ดูเบากว่าค่ะะะ"]),
    ("", ["店員さんに「すぐ送ります。ご安心ください。」と言われました。", "箱（濡れていました。）の中身は無事でした！！！", "本当に届くのか……と心配していました。", "No.387の椅子を注文しました。👍🏽", "Ver.5.33に更新したら、音が消えました。"]),
    ("", ["卖家说：“今天发货。请放心。”然后就没有消息了。", "朋友说“真不错！”。👩‍🔧", "重量大约17.7公斤。", "看起来结实；摸起来也轻便？"]),
    ("\n \r\n", ["Broke after a week", "- lum heavy", "1. first point without a mark", "No end here"]),
    (" ", ["the speaker works at night.", "it came with clips, a cloth, etc.", "delivery was promised by 3 p.m.", "mr. lum said so.", "(we bought it as a gift.)", "the seller wrote “it ships today. no worries.” and then went silent.", "my sister said “best lamp ever!”", "we keep it."]),
]


@pytest.mark.parametrize("joint, parts", CASES)
def test_sentences(joint, parts):
    text = joint.join(parts)
    assert [text[a:b] for a, b in S.spans(text)] == parts


@pytest.mark.parametrize("joint", ["\t", "\xa0", "  ", "\n", "\r\n", "　"])
def test_any_white_space_parts_sentences(joint):
    text = f" {joint}One is here.{joint}Two is there!{joint}"
    assert [text[a:b] for a, b in S.spans(text)] == ["One is here.", "Two is there!"]


@pytest.mark.parametrize("one", ["\n", "\r\n", "\r", " \r\n "])
def test_one_line_break_does_not_part_a_sentence_but_a_blank_line_does(one):
    text = f"Depois de uma{one}semana adorei. Has anyone else{one}tried it?"
    assert len(S.spans(text)) == 2
    blank = f"Depois de uma{one}{one.lstrip(" ")}semana"
    assert [blank[a:b] for a, b in S.spans(blank)] == ["Depois de uma", "semana"]


def test_nothing_is_lost_and_nothing_overlaps():
    for joint, parts in CASES:
        text = joint.join(parts * 3)
        at = 0
        for a, b in S.spans(text):
            assert at <= a < b and not text[at:a].strip()
            at = b
        assert not text[at:].strip()


def test_unpaired_marks_hide_nothing():
    text = 'A 5" screen came. It (works. Nobody knows. “Why?'
    assert [text[a:b] for a, b in S.spans(text)] == ['A 5" screen came.', "It (works.", "Nobody knows.", "“Why?"]


@pytest.mark.parametrize("text", ["x" * 400_000, "a.b" * 60_000, "; " * 60_000, "(" * 60_000, '"a" ' * 60_000, "あ。" * 60_000, "..." * 60_000, "ครับ " * 40_000])
def test_long_texts(text):
    found = S.spans(text)
    assert found and found[-1][1] == len(text.rstrip())


def test_query_on_nulls_and_empty_tables(spark):
    rows = [(1, None, 0), (2, "", 0), (3, " \n　", 0), (4, "One. Two.", 0), (4, "One. Two.", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, begin_char bigint")
    assert sorted(tuple(r) for r in S.sentence_spans(df).collect()) == [(4, 0, 4), (4, 0, 4), (4, 5, 9), (4, 5, 9)]
    assert S.sentence_spans(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "joint, parts",
    [
        (" ", ["He wrote “Sad :( :( :( :( :( :( :( :( :( :( today. No luck.” and left.", "So it is."]),
        (" ", ["See https://" + "a" * 150 + ".Html for more.", "So it is."]),
        (" ", ["ดี" + "ค่" + "ะ" * 60, "ดีครับ"]),
        ("", ["店員さんに「はい" + "！" * 250 + "」と言われました。", "本当です。"]),
    ],
)
def test_nothing_is_too_far_to_be_seen(joint, parts):
    text = joint.join(parts)
    assert [text[a:b] for a, b in S.spans(text)] == parts


@pytest.mark.parametrize("text", ["(" * 200_000 + "”" * 200_000, ("“(" * 50_000) + ("”" * 50_000), "a." * 200_000, "ะ​ ​ " * 100_000, "x@" + ".A" * 200_000, "「！」" * 100_000])
def test_long_searches_take_linear_time(text):
    from time import process_time

    began = process_time()
    S.spans(text)
    assert process_time() - began < 20


#: Texts of other kinds than the documents': contracts, recipes, news, code, chats.
UNSEEN = [
    (" ", ["1.1. Scope.", "The text applies to all parties.", "1.2.3. Terms (see annex 2. It is binding.) and dates.", "It was 1.1.", "Next."]),
    (" ", ["IV. Results of the second trial were mixed.", "XII. Outlook."]),
    (" ", ["กินข้าวหรือยัง", "ไม่รู้"]),
    (" ", ["Use mirror.debian.org or docs.python.org/3/library/re.html for that.", "Then run a.out again."]),
    (" ", ["she said “he told me ‘go (now. please.)’ and ran.” and then she left.", "we stayed."]),
    (" ", ["The U.N. met at 5 p.m. in Geneva.", "Nobody (not even the press!) was let in.", "Why?!", "See p. 12."]),
    (" ", ["Il pleut.", "« Vraiment ? » demanda M. Petit.", "Oui !"]),
    ("", ["他问：“（真的吗？）你看《三体。》了没有？”没人回答。", "然后呢？"]),
    (" ", ["बारिश हो रही है।", "क्या तुम (डॉ. राव के साथ) आओगे?"]),
    (" ", ["[Editor's note: it rained. A lot.]", "The match [see above. Below.] went on.", "Final score 3.5 to 2."]),
    ("\n\n", ["Item one has no stop", "(a bracket that never closes. Still two", "“A quotation, closed. Whole.” he said"]),
]


@pytest.mark.parametrize("joint, parts", UNSEEN[:-1])
def test_texts_of_other_kinds(joint, parts):
    text = joint.join(parts)
    assert [text[a:b] for a, b in S.spans(text)] == parts


def test_frames_that_close_take_back_what_was_found_inside():
    joint, parts = UNSEEN[-1]
    text = joint.join(parts)
    assert [text[a:b] for a, b in S.spans(text)] == ["Item one has no stop", "(a bracket that never closes.", "Still two", "“A quotation, closed. Whole.” he said"]
    nested = "Ann (bob [cut. Dug “eat. Far.” got. Hit] ill. Jug) keen. Low."
    assert [nested[a:b] for a, b in S.spans(nested)] == ["Ann (bob [cut. Dug “eat. Far.” got. Hit] ill. Jug) keen.", "Low."]
    stray = "Ann (bob [cut. Dug) eat. Far."
    assert [stray[a:b] for a, b in S.spans(stray)] == ["Ann (bob [cut. Dug) eat.", "Far."]
