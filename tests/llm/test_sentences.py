import pytest

from quernwork.llm.sentences import language, sentence_spans, sentences


def units(text, lang=None):
    return [text[a:b] for a, b in sentence_spans(text, lang)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Dr. T. Hadrell signed it. The U.S. lot is 3.5 t. Yes.", ["Dr. T. Hadrell signed it.", "The U.S. lot is 3.5 t.", "Yes."]),
        ('She asked, "Who moved it? The lid was open." We left.', ['She asked, "Who moved it? The lid was open."', "We left."]),
        ('"Stop!" shouted the lead. (It worked.) Fine', ['"Stop!" shouted the lead.', "(It worked.)", "Fine"]),
        ("Deliveries stop at 4 p.m. Friday. We close at 9 p.m. You may go.", ["Deliveries stop at 4 p.m. Friday.", "We close at 9 p.m.", "You may go."]),
        ("It runs for all six lines.A typical day begins. Wait for it... then go.", ["It runs for all six lines.", "A typical day begins.", "Wait for it... then go."]),
        ("Heading\n\nA line\nthat goes on. Next\none.\n\n- item one\n- item two. more\n1) x", ["Heading", "A line\nthat goes on.", "Next\none.", "item one", "item two. more", "x"]),
        ("See https://a.invalid/b.c?d=1.2 for No. 11, not No. 3. Write to a.b@c.invalid now.", ["See https://a.invalid/b.c?d=1.2 for No. 11, not No. 3.", "Write to a.b@c.invalid now."]),
        ("班长说：“停下。别碰它。”夜班检查。“在哪里？”她问道。", ["班长说：“停下。别碰它。”", "夜班检查。", "“在哪里？”她问道。"]),
        ("班長は「止めて。触らないで。」と言いました。時給は4300円（別。）です。", ["班長は「止めて。触らないで。」と言いました。", "時給は4300円（別。）です。"]),
        ("ค่าจ้าง 3500 บาทต่อวัน เราต้องการคน", ["ค่าจ้าง 3500 บาทต่อวัน", "เราต้องการคน"]),
        ("قال المشرف: «توقف. لا تلمسه.» وزن د. مرزان العينة.", ["قال المشرف: «توقف. لا تلمسه.»", "وزن د. مرزان العينة."]),
        ("डॉ. वर्दन ने नमूना तौला। नमी 3.75 प्रतिशत है।", ["डॉ. वर्दन ने नमूना तौला।", "नमी 3.75 प्रतिशत है।"]),
        ("Ποιος υπέγραψε το βιβλίο; Ζητάμε άτομο· η πείρα δεν απαιτείται.", ["Ποιος υπέγραψε το βιβλίο;", "Ζητάμε άτομο· η πείρα δεν απαιτείται."]),
        ("Am 3. Mai beginnt es im 2. Stock, vgl. S. 2. „Halt! Nein“, rief sie.", ["Am 3. Mai beginnt es im 2. Stock, vgl. S. 2.", "„Halt! Nein“, rief sie."]),
        ("« Arrêtez ! » a crié M. Dromby. Bienvenue !", ["« Arrêtez ! » a crié M. Dromby.", "Bienvenue !"]),
        ("—¿Está limpio? —preguntó la jefa. ¡Qué semana!", ["—¿Está limpio? —preguntó la jefa.", "¡Qué semana!"]),
        ("", []), (None, []), (" \n\t ", []), ("x", ["x"]),
    ],
)
def test_units(text, want):
    assert units(text) == want


def test_unbalanced_quote_doesnt_swallow_the_text():
    text = '"Open. ' + "A sentence here. " * 60
    assert len(units(text)) > 50


def test_long_text_is_linear():
    text = "This is a sentence about nothing. " * 20_000
    assert len(sentence_spans(text, "en")) == 20_000


def test_language():
    assert language(None, "Le chef et les autres dans la salle") == "fr" and language("EN-ca", "x") == "en" and language("jp", "") == "ja" and language("und", "Wir sind nicht der Chef und") == "de"


def test_frame(spark):
    df = spark.createDataFrame([(1, "A b. C d.", "en", "clash"), (1, "A b. C d.", "en", "clash"), (2, None, None, None), (None, "X.", "zz", ""), (3, "  ", "en", "")], "doc_id long, text string, lang string, start_pos string")
    got = sorted((tuple(r) for r in sentences(df).collect()), key=str)
    assert got == sorted([(1, 0, 4), (1, 5, 9), (1, 0, 4), (1, 5, 9), (None, 0, 2)], key=str)
    assert sentences(df.limit(0)).count() == 0


def test_long_quotations_and_late_scripts():
    """Length decides nothing: a long quotation or bracket is treated as a short one, and the whole text tells the language."""
    for a, b in ("«»", "()", '""', "“”"):
        few, many = (f"The foreman told us {a}{'It is cold here. ' * n}We stay.{b} and went home. Then we left." for n in (2, 60))
        assert len(units(few)) == len(units(many)) == 2
    head = "1234 5678 " * 60
    assert language(None, head + "Ο φούρνος είναι ζεστός. " * 10) == "el" and language("xx", head + "Печь горячая. " * 10) == "ru"
    assert language(None, "Zyx qwv. " * 300 + "Der Ofen ist nicht warm und das Lager ist voll. " * 9) == "de"
    assert language(None, "The gap of the dryer is 5 μm and the rest is to be set by you. " * 3) == "en"


def test_terminators_of_all_scripts():
    """Every character with the standard's property ends a sentence."""
    import regex

    from quernwork.llm.sentences import DOTS, STRONG

    assert all(c in STRONG + DOTS for c in map(chr, range(0x20000)) if regex.match(r"\p{Sentence_Terminal}", c))
    for stop in "։܀߹၊꧈᱾᰻꯫᥄﹖﹗":
        assert len(sentence_spans(f"Абв где{stop} Жзи кл{stop}", None)) == 2
