"""Word lists and lookup tables. All of this file are fixed values that results depend on."""

# Months: capital, title and three-letter forms. "April" (title) and "Sep" have no entry.
MONTHS = {
    "JANUARY": "01", "January": "01", "JAN": "01", "Jan": "01",
    "FEBRUARY": "02", "February": "02", "FEB": "02", "Feb": "02",
    "MARCH": "03", "March": "03", "MAR": "03", "Mar": "03",
    "APRIL": "04", "APR": "04", "Apr": "04",
    "MAY": "05", "May": "05",
    "JUNE": "06", "June": "06",
    "JULY": "07", "July": "07",
    "AUGUST": "08", "August": "08", "AUG": "08", "Aug": "08",
    "SEPTEMBER": "09", "September": "09", "SEPT": "09", "Sept": "09",
    "OCTOBER": "10", "October": "10", "OCT": "10", "Oct": "10",
    "NOVEMBER": "11", "November": "11", "NOV": "11", "Nov": "11",
    "DECEMBER": "12", "December": "12", "DEC": "12", "Dec": "12",
}
DOLLARS = ("$", "Dollars", "dollars")
PERCENTS = ("%", "percent", "percentage")
POSTFIXES = {
    "Thousand": 1e3, "THOUSAND": 1e3, "thousand": 1e3, "K": 1e3, "k": 1e3,
    "Million": 1e6, "MILLION": 1e6, "million": 1e6, "m": 1e6, "M": 1e6,
    "Billion": 1e9, "BILLION": 1e9, "billion": 1e9, "B": 1e9, "b": 1e9, "bn": 1e9, "Bn": 1e9, "BN": 1e9,
    "Trillion": 1e12, "TRILLION": 1e12, "trillion": 1e12, "T": 1e12, "t": 1e12,
}
DISTANCES = {"km": "km", "KM": "km", "Km": "km", "cm": "cm", "CM": "cm", "mm": "mm", "MM": "mm", "nm": "nm", "NM": "nm"}
WEIGHTS = {"kg": "kg", "KG": "kg", "Kg": "kg", "g": "g", "G": "g", "mg": "mg", "MG": "mg"}
BETWEEN = ("Between", "BETWEEN", "between")
AND = ("and", "AND", "And")

#: Stripped from the end of a following expression.
STOP_CHARS = r"[.,!:\"\-|\]?;\\/><\[]+$"
#: Deleted from the text before anything else.
SYMBOLS = r"[{}()|@#^&*+=_']"
NUMERIC = r"\d+([,]\d)*([.]\d+)?"
#: A whole run of word characters and hyphens that has a hyphen.
HYPHEN_RUN = r"(?<![\w-])\w*+-[\w-]*"
NO_WORD_BEFORE = r"(?<![-$<\p{L}\p{N}\p{M}_])"
#: ASCII words that touch no letter, digit or mark outside ASCII, and none of - $ < before or - > after.
WORD = r"(?<![-$<\p{L}\p{N}\p{M}_])\w+(?![->\p{L}\p{N}\p{M}_])"
WORD_AT_END = r"(?<![-$<\p{L}\p{N}\p{M}_])\w+$"
NEXT_WORD = r"^([\p{L}\p{Nd}-]*)"
IS_NUMBER = r"^\d[\d,]*(\.[\d,]*)?$"
WORD_NUMBER = r"^\d[\d,]*(\.[\d,]*)?[KkmMBbTt]$"

#: English function words used where no stop-word file is given.
STOP_WORDS = tuple(
    "a about above after again against all am an and any are as at be because been before being below between both but by "
    "can could did do does doing down during each few for from further had has have having he her here hers him his how i if "
    "in into is it its itself just me more most my myself no nor not now of off on once only or other our ours out over own "
    "same she should so some such than that the their theirs them then there these they this those through to too under until "
    "up very was we were what when where which while who whom why will with would you your yours".split()
)
