"""Sentences in legacy code pages are read as they were written."""

import pytest

from tessera.sources import encodings, files

SAID = {
    "cp1252": ["Der Käufer zahlt für die Übergabe der Räume, außer wenn Mängel größer sind.", "Le locataire règle le loyer à la première échéance; c’est l’usage, déjà prévu.", "El señor Muñoz pagará mañana según el capítulo décimo.", "She said “no” – and that was it…", "Überall GRÖSSE und Ärger"],
    "cp1250": ["Příliš žluťoučký kůň úpěl ďábelské ódy v září.", "Najemca płaci czynsz, gdyż właściciel żąda zapłaty każdego miesiąca.", "A bérlő megfizeti a díjat, különösen ősszel és űrlapon."],
    "cp1251": ["Арендатор платит за помещение каждый месяц, кроме августа.", "ДОГОВОР аренды № 5 от «первого» мая", "Съешь ещё этих мягких французских булок"],
    "koi8_r": ["Арендатор платит за помещение каждый месяц, кроме августа.", "Съешь ещё этих мягких французских булок, да выпей чаю"],
    "cp866": ["Арендатор платит за помещение каждый месяц, кроме августа."],
    "cp1253": ["Ο ενοικιαστής πληρώνει το μίσθωμα κάθε μήνα στην Αθήνα."],
    "cp1255": ["השוכר ישלם את דמי השכירות בכל חודש"],
    "shift_jis": ["賃借人は毎月の家賃を支払うものとする。", "これはテストです"],
    "euc_jp": ["賃借人は毎月の家賃を支払うものとする。"],
    "gb18030": ["承租人应当在每个月的第一天支付租金，这是我们的约定。"],
    "big5": ["承租人應當在每個月的第一天支付租金，這是我們的約定。"],
    "euc_kr": ["임차인은 매월 임대료를 지급하여야 한다."],
}


@pytest.mark.parametrize(("page", "text"), [(p, t) for p, texts in SAID.items() for t in texts])
def test_code_pages(page, text):
    assert encodings.decoded(text.encode(page)) == text
    assert encodings.decoded((text + "\nplain ASCII between\n" + text).encode(page)).endswith(text)


def test_marks_and_utf8():
    assert encodings.decoded("﻿ä".encode()) == "ä" and encodings.decoded("ä€".encode("utf-16")) == "ä€"
    assert encodings.decoded("größer".encode()) == "größer" and encodings.decoded(b"") == "" and encodings.decoded(b"abc") == "abc"
    assert files.decoded("Überall größer".encode("cp1252")) == "Überall größer"
    assert encodings.decoded(bytes(range(128, 256))) is not None


def test_long_texts_count_wholly():
    """The evidence may stand at the very end."""
    raw = b"plain words only " * 50_000 + SAID["cp1251"][0].encode("cp1251")
    assert encodings.decoded(raw).endswith(SAID["cp1251"][0])
