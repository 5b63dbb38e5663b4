"""Descriptions of the stand-in ledger: a small grammar over the rules' own tables, so that rows reach every rule.

Row i takes form i modulo the number of forms; with j, the number of rounds before it, each slot of the form takes a word of
its list. Spark and the SQL of the tests build the same text from the lists here.
"""

from __future__ import annotations

from .. import rules as R

TOWNS = ["ARAD", "BACAU", "BUCURESTI", "CLUJ", "IASI", "ORADEA", "RO", "TIMISOARA"]
PERSONS = ["Ilinca Barbu", "Tudor Sava", "Mara Enache", "Horia Lupu", "Oana Dima"]
MONTHS = ["IANUARIE", "FEBRUARIE", "MARTIE", "APRILIE", "MAI", "IUNIE", "IULIE", "AUGUST", "SEPTEMBRIE", "OCTOMBRIE", "NOIEMBRIE", "DECEMBRIE"]
#: Shops that no rule knows.
UNKNOWN_SHOPS = [f"{kind} {name}" for kind in ("ATELIER", "CAFENEA", "LIBRARIA") for name in ("MOLID", "ZORI")]
SHOPS = list(dict.fromkeys([*(s for spellings in R.ALIASES.values() for s in spellings), "AUCH", *(t.upper() for t in R.UTILITY_TERMS), *UNKNOWN_SHOPS]))
PURPOSES = [*(t for c in ("housing", "utilities", "salary_income") for t in R.TRANSFER_TERMS[c]["exact_terms"]), "cadou", "imprumut"]
ENTITIES = [f"RO{10 + k}LOOM{k:016d}" for k in range(25)]

#: A slot's words, and after how many rounds the next one comes.
SLOTS = {
    "shop": (SHOPS, 1),
    "town": (TOWNS, 3),
    "person": (PERSONS, 2),
    "month": (MONTHS, 1),
    "purpose": (PURPOSES, 1),
    "entity": (ENTITIES, 1),
    "against": (R.TRANSFER_TERMS["housing"]["negative_terms"], 1),
    "cash": (R.ATM_HINTS, 1),
    "fee": (R.FEE_HINTS, 1),
    "internal": (R.INTERNAL_HINTS, 1),
    "external": (R.EXTERNAL_HINTS, 1),
    "salary": (R.SALARY_HINTS, 1),
}
#: Slots that are numbers: the round, two rounds as a pair, and an amount.
NUMBERS = ("n", "pair", "amount")
SALARY = "{salary} {month}"
SILENT = "{external}; Casa Verde"
FORMS = [
    "POS {shop} {town}",
    "EPOS {shop}",
    "POS {shop} TID:{n} {amount} RON",
    "{cash} {n}",
    "{external}; {person}; {purpose} {entity}",
    "EPOS {shop} https://plati.example/{n}",
    SALARY,
    "PLATA LA POS {shop} REF {n}",
    "{internal} REF: T{pair}",
    "POS {town}",
    "{external}; {person}; fara detalii {entity}",
    "POS UNKNOWN {shop} {town} {n}",
    "{fee} {month}",
    SILENT,
    "POS {shop} COMISION TRANZACTIE {amount}",
    "{external}; {person}; {purpose} REF: P{pair}",
    "{external}; {person}; {against} {purpose}",
    "diverse {n}",
]
