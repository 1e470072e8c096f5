"""Parts that replacement values are spelled from: three locales for people and places."""

from typing import NamedTuple


class Locale(NamedTuple):
    """Sounds of syllables, 16 consonants and 4 vowels, and endings, as many in each locale."""

    c: str
    v: str
    surnames: list[str]
    towns: list[str]
    roads: list[str]
    regions: list[str]
    # '#' stands for a digit, '?' for a capital.
    post: str


#: Endings in each list of a locale.
LISTED = 4

LOCALES = [
    Locale(
        "bcdfghjklmnprstw", "aeio", ["son", "man", "ford", "er"], ["field", "side", "burg", "view"],
        ["Avenue", "Street", "Drive", "Boulevard"], [", IL", ", CA", ", WI", ", TX"], "#####",
    ),
    Locale(
        "bcdghjklmnprstvy", "aiue", ["kar", "wal", "rao", "nath"], ["pur", "nagar", "abad", "garh"],
        ["Marg", "Road", "Nagar", "Chowk"], [", Maharashtra", ", Rajasthan", ", Karnataka", ", Kerala"], "######",
    ),
    Locale(
        "bcdfghklmnprstvw", "aeou", ["worth", "ley", "wood", "wick"], ["ton", "ham", "bury", "mouth"],
        ["Lane", "Close", "Terrace", "Road"], [", Norfolk", ", Kent", ", Devon", ", Fife"], "??# #??",
    ),
]

COMPANY_ENDS = ["Group", "Ltd", "Inc", "and Sons", "Partners", "LLC", "PLC", "Industries"]

MAIL_HOSTS = ["example.com", "example.org", "example.net"]

# '#' stands for a digit, 'N' for one of 2-9, 'M' for one of 6-9.
PHONE_SHAPES = [
    "N##-N##-####",
    "(N##) N##-####",
    "+1-N##-N##-####",
    "N##.N##.####",
    "+91 M#########",
    "M#########",
    "0M#########",
]
