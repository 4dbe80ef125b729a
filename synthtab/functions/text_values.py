"""Text values: word banks, the rules that choose one for a column, builders."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synthtab.functions.rng import Draw

# ---- word banks of our own -------------------------------------------------

CITIES = [
    "Lisbon", "Oslo", "Nairobi", "Quito", "Hanoi", "Krakow", "Bergen", "Tallinn",
    "Porto", "Cusco", "Turin", "Ghent", "Malmo", "Perth", "Dakar", "Lima",
    "Riga", "Split", "Accra", "Davao", "Leeds", "Omaha", "Austin", "Tampa",
    "Fargo", "Boise", "Kobe", "Busan", "Cairns", "Graz",
]
MERCHANTS = [
    "Bakery", "Bookshop", "Butcher", "Car Rental", "Cinema", "Cobbler", "Deli",
    "Dentist", "Florist", "Garden Centre", "Gym", "Hotel", "Laundry", "Optician",
    "Parking", "Pet Shop", "Stationer", "Tailor", "Toy Shop", "Winery",
]
PAYMENTS = [
    "Bank Transfer", "Card", "Direct Debit", "Gift Voucher", "Invoice",
    "Mobile Pay", "Money Order", "Prepaid", "Store Credit", "Wire",
]
FIRST_NAMES = [
    "Ada", "Bruno", "Chloe", "Dmitri", "Elif", "Fatou", "Goran", "Hanna", "Ivo",
    "Jun", "Kofi", "Lena", "Mateo", "Nora", "Omar", "Petra", "Quinn", "Rosa",
    "Sven", "Tala",
]
LAST_NAMES = [
    "Abbott", "Berg", "Costa", "Dubois", "Eriksen", "Fischer", "Garcia", "Haddad",
    "Ito", "Jansen", "Kowalski", "Larsen", "Moreau", "Novak", "Okafor", "Petrov",
    "Rossi", "Santos", "Tanaka", "Weber",
]
STATUSES = ["Approved", "Archived", "Blocked", "Closed", "Draft", "Open"]
COUNTRIES = ["Brazil", "Chile", "Egypt", "France", "Ghana", "Kenya", "Norway", "Vietnam"]
DEPARTMENTS = ["Design", "Legal", "Logistics", "Procurement", "Quality", "Research", "Security"]
MAIL_DOMAINS = [
    "example.com", "example.net", "example.org", "mail.example", "post.example", "inbox.example",
]

# ---- fixed values: closed label sets with their chances --------------------

FRAUD_LABELS, FRAUD_CHANCES = ["No", "Yes"], [0.95, 0.05]
GENDERS = ["Male", "Female", "Other"]
RATINGS = ["1", "2", "3", "4", "5"]
CLASSES = ["A", "B", "C", "D"]
YES_NO = ["Yes", "No"]

# ---- builders --------------------------------------------------------------

Maker = Callable[["TextStream"], Column]


@dataclass(frozen=True)
class TextStream:
    """Hands out independent draws for one text column."""

    key: Column
    seed: int
    column: str

    def draw(self, part: int = 0) -> Draw:
        return Draw(self.key, self.seed, f"{self.column}:text", part)


def identifier(prefix: str, digits: int) -> Maker:
    """``PREFIX-000123``; drawn from [1, 10^digits), so not unique."""

    def make(s: TextStream) -> Column:
        number = s.draw().integer(1, 10**digits).cast("string")
        return F.concat(F.lit(f"{prefix}-"), F.lpad(number, digits, "0"))

    return make


def one_of(values: list[str]) -> Maker:
    return lambda s: s.draw().pick(values)


def weighted(values: list[str], chances: list[float]) -> Maker:
    return lambda s: s.draw().weighted_pick(values, chances)


def full_name(s: TextStream) -> Column:
    names = s.draw()
    return F.concat_ws(" ", names.pick(FIRST_NAMES), names.pick(LAST_NAMES, second=True))


def email(s: TextStream) -> Column:
    names = s.draw()
    return F.concat(
        F.lower(names.pick(FIRST_NAMES)),
        F.lit("."),
        F.lower(names.pick(LAST_NAMES, second=True)),
        F.lit("@"),
        s.draw(1).pick(MAIL_DOMAINS),
    )


def phone(s: TextStream) -> Column:
    digits = s.draw()
    return F.concat(
        F.lit("+91-"),
        digits.integer(70000, 99999).cast("string"),
        digits.integer(10000, 99999, second=True).cast("string"),
    )


def site(s: TextStream) -> Column:
    return F.concat(F.lower(s.draw().pick(FIRST_NAMES)), F.lit(".com"))


# ---- rules, most specific first --------------------------------------------


@dataclass(frozen=True)
class TextRule:
    label: str
    pattern: str
    make: Maker


# The name patterns, in matching order.
RULES: list[TextRule] = [
    TextRule("id_trn", r"(transaction|trn|txn|order|invoice)_?(id|num|number|ref|code)", identifier("TRN", 6)),
    TextRule("id_cust", r"(customer|user|client|member|patient)_?(id|num|number)", identifier("CUST", 5)),
    TextRule("id_prd", r"(product|item)_?(id|num|code|sku)", identifier("PRD", 4)),
    TextRule("id_emp", r"(employee|emp|staff)_?(id|num)", identifier("EMP", 4)),
    TextRule("id_ord", r"(order|purchase)_?(id|num)", identifier("ORD", 6)),
    TextRule("id_acc", r"(account)_?(id|num)", identifier("ACC", 6)),
    TextRule("city_exact", r"^(city|town|location|place|region|district)$", one_of(CITIES)),
    TextRule("city", r"(city|town|location|place)", one_of(CITIES)),
    TextRule("country", r"country", one_of(COUNTRIES)),
    TextRule("address", r"address", one_of(CITIES)),
    TextRule("merchant", r"(merchant|product|item)_?(categ|type|class|kind)", one_of(MERCHANTS)),
    TextRule("class", r"(categ|type|class|kind|segment)", one_of(CLASSES)),
    TextRule("department", r"department", one_of(DEPARTMENTS)),
    TextRule("payment", r"payment.*(method|type|mode)", one_of(PAYMENTS)),
    TextRule("fraud", r"(fraud|is_fraud|fraudulent)", weighted(FRAUD_LABELS, FRAUD_CHANCES)),
    TextRule("status", r"(status|state|condition)", one_of(STATUSES)),
    TextRule("gender", r"^(gender|sex)$", one_of(GENDERS)),
    TextRule("rating", r"^(rating|score|grade|rank)$", one_of(RATINGS)),
    TextRule("yes_no", r"^(yes_no|is_active|active|flag)$", one_of(YES_NO)),
    TextRule("full_name", r"^(name|full_name|customer_name|user_name)$", full_name),
    TextRule("first_name", r"^(first_name|fname)$", one_of(FIRST_NAMES)),
    TextRule("last_name", r"^(last_name|lname|surname)$", one_of(LAST_NAMES)),
    TextRule("email", r"email", email),
    TextRule("phone", r"(phone|mobile|contact|cell)", phone),
    TextRule("site", r"^(domain|website|url|site)$", site),
]


def find_rule(name: str, description: str | None = None, strict_names: bool = False) -> TextRule | None:
    """First rule that hits the column name or its description.

    The patterns are written with underscores, so the name is tried as it is
    and with ``_``/``-`` as spaces; ``strict_names`` tries the spaced form only.
    """
    lowered = name.lower()
    texts = [re.sub("[_-]", " ", lowered).strip()]
    if not strict_names:
        texts.append(lowered.strip())
    if description:
        texts.append(description)
    for rule in RULES:
        if any(re.search(rule.pattern, text, re.IGNORECASE) for text in texts):
            return rule
    return None


def match_rules(
    df: DataFrame,
    name: str = "column_name",
    description: str | None = None,
    strict_names: bool = False,
    out: str = "rule",
) -> DataFrame:
    """``find_rule`` over a table of column names; NULL where none hits."""
    lowered = F.lower(F.col(name))
    texts = [F.trim(F.translate(lowered, "_-", "  "))]
    if not strict_names:
        texts.append(F.trim(lowered))
    if description is not None:
        texts.append(F.coalesce(F.col(description), F.lit("")))
    label = F.lit(None).cast("string")
    for rule in reversed(RULES):
        pattern = "(?i)" + rule.pattern
        hit = F.lit(False)
        for text in texts:
            hit = hit | text.rlike(pattern)
        label = F.when(hit, F.lit(rule.label)).otherwise(label)
    return df.withColumn(out, label)


# Words that carry no content in a description.
STOP_WORDS = [
    "that", "this", "with", "from", "where", "which", "their", "about", "would", "could",
    "should", "what", "when", "for", "the", "and", "are", "was", "has", "had",
]


def description_value(description: Column, draw: Draw) -> Column:
    """``Word_123`` from the first content word of a description."""
    words = F.regexp_extract_all(F.lower(description), F.lit(r"(?U)([\w']+)"), 1)
    content = F.filter(words, lambda w: (F.length(w) > 3) & ~w.isin(STOP_WORDS))
    base = F.get(content, F.lit(0))
    numbered = F.concat(F.initcap(base), F.lit("_"), draw.integer(1, 1000, second=True).cast("string"))
    return F.when(base.isNotNull(), numbered).otherwise(
        draw.pick(["Sample A", "Sample B", "Sample C"])
    )
