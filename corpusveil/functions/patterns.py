"""What counts as an identifier, a name, an address or an amount: rules over typed tokens.

Word classes are tables of fixed values. Rules say in which sequence of tokens a value stands; digits are
counted by token, not by character. E-mail addresses alone are read character by character.
"""

from __future__ import annotations

from itertools import product
from typing import NamedTuple

from .tokens import BLANK, BREAK, CAPITALS, INITIAL, LETTER, LETTERS, LINE, MIXED, ONE_BLANK, PATRONYMIC, PROPER, SMALL, SPACE, TITLED, Alphabet, Rule, number


class Pattern(NamedTuple):
    """Finds `value` after `context` and before `tail`, character by character."""

    context: str
    value: str
    tail: str = ""
    ignore_case: bool = True

    @property
    def java(self) -> str:
        return f"{'(?iu)' if self.ignore_case else ''}(?U)({self.context})({self.value}){self.tail}"


# The words that the rules know.
_UNITS = "ноль один одна одно одну два две три четыре пять шесть семь восемь девять десять"
_TEENS = "один две три четыр пят шест сем восем девят"
COMPANY_FORMS, INSTITUTION_FORMS = "ООО ПАО АО ЗАО ОАО ИП", "ГАУ ГБУ МБУ ФГБУ"
SUPPLIER_WORDS, BUYER_WORDS = "поставщик исполнитель подрядчик продавец", "покупатель заказчик клиент"
LONG_FORMS = {"общество с ограниченной ответственностью": "ооо", "индивидуальный предприниматель": "ип"}
CASES = ("", "а", "у", "ом", "е")
MONEY_COLUMNS = ("цена", "сумма", "стоимость")


def numerals() -> str:
    """Number words: units; teens and tens from their stems; hundreds; scales with their endings."""
    tens = ["двадцать", "тридцать", "сорок", *(f"{x}ьдесят" for x in ("пят", "шест", "сем", "восем")), "девяносто"]
    hundreds = ["сто", "двести", "триста", "четыреста", *(f"{x}ьсот" for x in ("пят", "шест", "сем", "восем", "девят"))]
    scales = [f"тысяч{x}" for x in ("", "а", "и", "у")] + [f"{s}{x}" for s in ("миллион", "миллиард") for x in ("", "а", "ов")]
    return " ".join([_UNITS, *(f"{x}надцать" for x in _TEENS.split()), *tens, *hundreds, *scales])


WORDS = Alphabet({
    "inn": "инн", "kpp": "кпп", "ogrn": "огрн", "ogrnip": "огрнип", "bik": "бик", "phone": "телефон", "phone.": "тел моб", "address": "адрес",
    "с": "с", "л": "л", "рк": "р к", "personal": "лицевой", "current": "расчётный расчетный корреспондентский", "account": "счёт счет",
    "contract": " ".join(f"{w}{x}" for w in ("договор", "контракт") for x in CASES), "number": "n номер", "в": "в", "лице": "лице",
    "post": "руководитель директор бухгалтер", "responsible": "ответственное", "person": "лицо", "company": COMPANY_FORMS.lower(), "institution": INSTITUTION_FORMS.lower(),
    "общество": "общество", "ограниченной": "ограниченной", "ответственностью": "ответственностью", "муниципальное": "муниципальное", "бюджетное": "бюджетное",
    "общеобразовательное": "общеобразовательное", "учреждение": "учреждение", "мбоу": "мбоу", "сош": "сош", "town": "г", "street": "ул просп пер", "пр": "пр", "т": "т",
    "house": "д", "part": "стр корп кв оф", "rouble": "рублей рубля рубль", "руб": "руб", "rub": "rub", "money": "долларов евро", "kopeck": "копеек копейки копейка", "коп": "коп",
    "numeral": numerals(),
})

w, ANY_WORD, ANY_NUMBER = WORDS.word, WORDS.word(), number()
#: Nothing that goes on with a word or number stands before, or behind.
_FREE, _END = f"(?<!{ANY_WORD}|{ANY_NUMBER})", f"(?!{ANY_WORD}|{ANY_NUMBER})"
_NAMED = (PROPER, PATRONYMIC)
_LONGER = (SMALL, *_NAMED, CAPITALS, MIXED, LETTERS)
_CYRILLIC = (*_LONGER, INITIAL, LETTER)


def either(*parts: str) -> str:
    return f"(?:{'|'.join(parts)})"


def spread(*parts: str, by: str = f"{SPACE}+") -> str:
    """Parts with something between them."""
    return by.join(parts)


def fresh(part: str, first: str = "") -> str:
    """A part before which no word or number goes on. How it begins is looked at first: few tokens begin so, and to look back costs more."""
    return f"(?={first or part}){_FREE}{part}"


def labelled(*labels: str) -> str:
    """A label that stands alone, perhaps with a colon or number sign behind it."""
    return f"{fresh(either(*labels))}{_END}{LINE}*[:№]?{LINE}*"


def divided(groups: tuple[int, ...], by: str) -> str:
    """Digits in these groups, of which neighbours may be written as one run, or with `by` between them."""
    ways = []
    for cuts in product((False, True), repeat=len(groups) - 1):
        runs = [groups[0]]
        for cut, n in zip(cuts, groups[1:], strict=True):
            runs = [*runs, n] if cut else [*runs[:-1], runs[-1] + n]
        ways.append(by.join(number(n) for n in runs))
    return either(*ways)


def counted(*lengths: int) -> str:
    """The beginning of digits and blanks that has so many digits, of lengths the first that ends with a run."""
    return rf"\A(?:{'|'.join(rf'(?:\D*\d){{{n}}}(?!\d)' for n in lengths)})"


_SPACED_DIGITS = f"{ANY_NUMBER}(?:{BLANK}{ANY_NUMBER})*"
_BY_SLASH = f"{BLANK}?/{BLANK}?"
_BOTH = w("inn") + _BY_SLASH + w("kpp")
_CODE = f"(?:{ANY_WORD}|{ANY_NUMBER})*"
_MARK = f"(?:{ANY_WORD}|{ANY_NUMBER}|[./-])"
# Names: a surname may go on behind hyphens in small letters; initials have dots.
_TAIL = f"(?:-|{w(shapes=(SMALL, LETTER))})"
_CAPITAL = w(shapes=(*_NAMED, INITIAL))
_SURNAME = either(f"{w(shapes=_NAMED)}{_TAIL}*", f"{w(shapes=(INITIAL,))}-{_TAIL}*")
_ANY_NAME = either(w(shapes=_LONGER), f"{w(shapes=_CYRILLIC)}-") + f"(?:-|{w(shapes=_CYRILLIC)})*"
_WRITTEN = f"{w(shapes=_CYRILLIC)}(?:-|{w(shapes=_CYRILLIC)})*"


def initials(gap: str) -> str:
    return rf"{w(shapes=(INITIAL,))}\.{gap}*{w(shapes=(INITIAL,))}\."


_QUOTED = either(f"«[^»{BREAK}]+»", f'"[^"{BREAK}]+"')
_TITLE_WORD = f"{w(shapes=(*_NAMED, INITIAL, CAPITALS, MIXED, TITLED))}(?:{ANY_WORD}|{ANY_NUMBER}|[.-])*"


def titled(most: int) -> str:
    """A quoted name, or a capitalised word with so many more behind it."""
    return either(_QUOTED, f"{_TITLE_WORD}(?:{SPACE}+{_TITLE_WORD}){{0,{most}}}")


_SCHOOL = either(
    spread(w("общество", shapes=(PROPER,)), w("с", shapes=(LETTER,)), w("ограниченной", shapes=(SMALL,)), w("ответственностью", shapes=(SMALL,)), by=ONE_BLANK),
    spread(w("муниципальное", shapes=(PROPER,)), *(w(x, shapes=(SMALL,)) for x in ("бюджетное", "общеобразовательное", "учреждение")), by=ONE_BLANK), w("мбоу", shapes=(CAPITALS,)) + f"(?:{ONE_BLANK}{w('сош', shapes=(CAPITALS,))})?",
)
_UNIT = f"{ANY_NUMBER}(?:{w(shapes=_CYRILLIC)}|[/-])*"
_STREET = either(w("street") + r"\.", f"{w('пр')}-{w('т')}")
_NEXT = f",{SPACE}*"
_PLACE = f"[^;{BREAK}]+"
_SUM = f"(?<!{ANY_WORD}|{ANY_NUMBER}|[.,])" + either(f"{number(1, 2, 3)}(?:{ONE_BLANK}{number(3)})*", ANY_NUMBER) + f"(?:[,.]{number(2)})?"
_IN_WORDS = f"{w('numeral')}(?:{SPACE}+{w('numeral')}){{0,20}}"
_KOPECKS = f"(?:{SPACE}+{number(2)}{SPACE}+" + either(w("kopeck"), w("коп") + r"\.?") + ")?"
_THREE = spread(_SURNAME, _SURNAME, _SURNAME)

RULES: dict[str, tuple[Rule, ...]] = {
    # Ten or twelve digits after the taxpayer's label, alone or with the next one's.
    "inn": (Rule(labelled(_BOTH, w("inn")), _SPACED_DIGITS, "", counted(12, 10), ("inn",)),),
    # Nine characters, of which two may be letters, after their label, or after both and a taxpayer number.
    "kpp": (Rule(either(f"{labelled(_BOTH)}{_SPACED_DIGITS}{_BY_SLASH}", labelled(w("kpp"))), f"{number(*range(4, 10))}{_CODE}", "", r"(?iu)\A\d{4}[\dA-ZА-ЯЁ]{2}\d{3}\z", ("kpp",)),),
    "ogrn": (Rule(labelled(w("ogrnip")), _SPACED_DIGITS, "", counted(15), ("ogrnip",)), Rule(labelled(w("ogrn")), _SPACED_DIGITS, "", counted(13), ("ogrn",))),
    # Perhaps a country code, then 3, 3, 2 and 2 digits, however they are grouped.
    "phone": (Rule(
        f"{fresh(either(w('phone'), w('phone.') + chr(92) + '.?'), w('phone', 'phone.'))}{SPACE}*[:-]?{SPACE}*",
        either(*(f"{lead}{either(rf'{chr(92)}({number(3)}{chr(92)})(?:{SPACE}|-)*{divided((3, 2, 2), f'(?:{SPACE}|-)*')}', divided((3, 3, 2, 2), f'(?:{SPACE}|-)*'))}" for lead in (rf"\+{number(1)}{SPACE}*", f"{number(1)}{SPACE}*", "")), rf"\+?{divided((4, 3, 2, 2), f'(?:{SPACE}|-)*')}"),
        f"(?!{ANY_NUMBER})", r"(?s)\A(?:\+7|8(?=.*\d(?:\D*\d){9})|(?!\+)(?=\D*(?:\d\D*){10}\z)).*\z", ("phone", "phone."),
    ),),
    "bank_account": (
        Rule(labelled(f"{w('л')}{SPACE}*[./]{SPACE}*{w('с')}", spread(w("personal"), w("account"))), number(20, 11), needs=("л", "personal")),
        Rule(labelled(f"{w('рк')}{SPACE}*[./]{SPACE}*{w('с')}", spread(w("current"), w("account"))), number(20), needs=("рк", "current")),
    ),
    "bik": (Rule(labelled(w("bik")), number(9), needs=("bik",)),),
    # A mark with a digit, after a contract's name, up to four more words, and a number sign.
    "contract_number": (Rule(f"{fresh(w('contract'))}{_END}(?:{LINE}+{_WRITTEN}){{0,4}}{LINE}*" + either("№", w("number")) + f"{LINE}*[:-]?{LINE}*", f"(?=(?:{ANY_WORD}|[./-])*{ANY_NUMBER})(?:{ANY_WORD}|{ANY_NUMBER})(?:{_MARK}*(?:{ANY_WORD}|{ANY_NUMBER}))?", f"(?!{_MARK})", r"(?iu)\A[A-ZА-ЯЁ\d./-]+\z", ("contract",)),),
    # Surname, name and patronymic; surname and initials either way round; three names behind a slash or post before a mark; three before a mark where someone is represented.
    "person_name": (
        Rule("", fresh(spread(_SURNAME, _SURNAME, w(shapes=(PATRONYMIC,))), _CAPITAL), _END),
        Rule("", fresh(f"{_SURNAME}{BLANK}{initials(BLANK)}", _CAPITAL), _END), Rule("", fresh(f"{initials(BLANK)}{BLANK}*{_SURNAME}", _CAPITAL), _END),
        Rule(either(f"/{SPACE}*", either(w("post", shapes=(SMALL,)), spread(w("responsible", shapes=(SMALL,)), w("person", shapes=(SMALL,)), by=ONE_BLANK)) + f"{SPACE}*:?{SPACE}*"), _THREE, either(f"(?={SPACE}*[/,;])", rf"(?={BREAK}?\z)")),
        Rule(f"{fresh(spread(w('в'), w('лице')), w('в'))}(?:{SPACE}+{_ANY_NAME}){{0,5}}{SPACE}+", spread(_ANY_NAME, _ANY_NAME, _ANY_NAME), f"(?={SPACE}*[,;])"),
    ),
    # A form in full with a quoted name or a school's number; a short form with a name; an institution's with a name.
    "organization": (
        Rule("", spread(_SCHOOL, either(f"«[^»{BREAK}]+»", f"(?:{w('сош', shapes=(CAPITALS,))}{SPACE}*)?№{SPACE}*{ANY_NUMBER}")) + rf"(?:{SPACE}+{w('town', shapes=(LETTER,))}\.{SPACE}*{_SURNAME})?", needs=("общество", "муниципальное", "мбоу")),
        Rule("", fresh(spread(w('company', shapes=(CAPITALS,)), titled(4)), w('company', shapes=(CAPITALS,))), needs=("company",)),
        Rule("", f"{fresh(w('institution', shapes=(CAPITALS,)))}(?:{SPACE}+{w(shapes=(CAPITALS,))})?{SPACE}+{titled(4)}", needs=("institution",)),
    ),
    # Postal code, town, street, house and its parts; or what follows a label to the clause's end, and a second line that goes on with a part of an address.
    "address": (
        Rule("", f"(?<!{ANY_NUMBER})" + _NEXT.join((number(6), rf"{w('town')}\.{SPACE}*{_WRITTEN}", f"{_STREET}{SPACE}*[^,;{BREAK}]+", rf"{w('house')}\.{SPACE}*{_UNIT}")) + rf"(?:{_NEXT}{w('part')}\.{SPACE}*{_UNIT})*", needs=("town",)),
        Rule(f"{fresh(w('address'))}{SPACE}*:{SPACE}*", f"{_PLACE}(?:{BREAK}" + either(w("town"), w("street"), w("house")) + rf"\.{_PLACE})?", "", r"(?s)\A[^\r\n]{5,}(?:\r?\n.*)?", ("address",)),
    ),
    # A sum, perhaps in words behind it, and a currency, perhaps with kopecks; or a sum in words.
    "amount": (
        Rule("", _SUM + rf"(?:{SPACE}*\({_IN_WORDS}\))?{SPACE}*" + either(w("rouble"), w("руб") + r"\.?", "₽", w("money")) + _KOPECKS, _END),
        Rule("", f"{fresh(_IN_WORDS, w('numeral'))}{SPACE}+{w('rouble')}(?:{SPACE}+{number(2)}{SPACE}+{w('kopeck')})?"),
    ),
}

#: Rules of the deterministic stand-in for a model: full or shortened names, companies, labelled addresses, amounts in roubles.
_DOUBLE = f"{w(shapes=_NAMED)}(?:-{w(shapes=_NAMED)})?"
_LONE, _DONE = f"(?<!{ANY_WORD}|{ANY_NUMBER}|-)", f"(?!{ANY_WORD}|{ANY_NUMBER}|-)"
MOCK_RULES: dict[str, tuple[Rule, ...]] = {
    "person_name": (Rule("", _LONE + either(spread(_DOUBLE, _DOUBLE, _DOUBLE), spread(_DOUBLE, initials(SPACE))), _DONE),),
    "organization": (Rule("", f"{_FREE}{spread(w('company', shapes=(CAPITALS,)), titled(3))}"),),
    "address": (Rule(f"{w('address')}{SPACE}*:{SPACE}*", _PLACE),),
    "amount": (Rule("", f"{_FREE}{ANY_NUMBER}(?:{ONE_BLANK}{number(3)})*(?:[.,]{number(1, 2)})?{SPACE}*" + either(w("rouble") + r"\.?", w("руб") + r"\.?", "₽", w("rub")), _END),),
}

_HOST = "[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?"
#: A local part, and two or more host labels that begin and end with a letter or digit.
EMAIL = Pattern("", rf"(?<![\w.+-])[A-Z0-9.!#$%&'*+/=?^_`{{|}}~-]+@{_HOST}(?:\.{_HOST}){{1,126}}", r"(?![\w-])")


def _listed(words: str) -> str:
    return either(*words.split())


def _alone(part: str) -> str:
    return rf"(?<!\w){part}(?!\w)"


SUPPLIER, BUYER = (Pattern("", _alone(_listed(words))) for words in (SUPPLIER_WORDS, BUYER_WORDS))
REPRESENTATION = Pattern("", _alone(r"(?:в\s+лице|действующ\w*\s+от\s+имени)"))

_ANY_CASE = "(?iu)(?U)"
LEGAL_FORMS = _ANY_CASE + _alone(either(*COMPANY_FORMS.lower().split(), *(r"\s+".join(form.split()) for form in LONG_FORMS)))
JOB_TITLE = _ANY_CASE + r"\A(?:генеральный\s+)?(?:директор|руководитель|главный\s+бухгалтер)\z"
MONEY_HEADER = _ANY_CASE + _alone(either(*MONEY_COLUMNS))
MONEY_CELL = r"(?U)\A\s*\d[\d\s.,]*\z"
SECTION = r"(?U)\A\d+\.\s+[А-ЯЁ ]{4,}\z"
INVOICE = _ANY_CASE + r"сч[её]т\s+на\s+оплату"
INVOICE_SUPPLIER = _ANY_CASE + r"\A\s*Поставщик\s*:"
INVOICE_SIGN = _ANY_CASE + either(_alone(r"[рк]\s*/\s*с"), "руководитель", "главный бухгалтер")
DATED = r"(?U)(?<!\w)\d{4}\s*г\.?"
