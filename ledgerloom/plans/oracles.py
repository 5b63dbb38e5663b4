"""The queries in SQL for an independent engine, from the same fixed values."""

from __future__ import annotations

from .. import rules as R
from ..functions.text import LINE_BREAK
from ..operators.expenses import TOTALS
from ..operators.merchants import LEGAL_NOISE
from ..operators.transfers import AREAS, TRANSFER_TYPES, normalised, terms_of
from ..sources import grammar as G
from .queries import BIAS, EXTERNAL, LATE, LITERALS, MEMORY, MONTH_COLUMNS, MONTH_WEIGHTS, NET, PATTERNS, RULES, WEIGHTS


def s(text) -> str:
    return "NULL" if text is None else "'" + str(text).replace("'", "''") + "'"


def listed(words) -> str:
    return ", ".join(map(s, words))


def has(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {s(w)})" for w in words) + ")" if words else "false"


def case(pairs, default="NULL") -> str:
    return "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in pairs) + f" ELSE {default} END"


def mapped(column: str, table: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {s(k)} THEN {s(v)}" for k, v in table.items()) + " END"


def table_of(rows, *names: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(s(x) if isinstance(x, str) or x is None else str(x) for x in r) + ")" for r in rows) + f") AS v({', '.join(names)})"


def canonical(t: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(upper(strip_accents({t})), '[^A-Z0-9*./&\s-]', ' ', 'g'), '\s+', ' ', 'g'))"


def registry_name(t: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(upper(strip_accents({t})), '[^A-Z0-9\s&.-]', ' ', 'g'), '\s+', ' ', 'g'))"


def plain(t: str) -> str:
    low = rf"regexp_replace(lower(strip_accents(coalesce({t}, ''))), '\b(?:ref|rrn|tid)\s*:?\s*[a-z0-9-]+\b', ' ', 'g')"
    words = rf"string_split(trim(regexp_replace(regexp_replace({low}, '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')), ' ')"
    return f"array_to_string(list_filter({words}, lambda w: w <> '' AND w NOT IN ({listed(x.lower() for x in R.NOISE_TOKENS)})), ' ')"


def tokens(name: str, screened: bool) -> str:
    extra = f" AND t NOT IN ({listed(R.LEGAL_SUFFIXES)}) AND lower(t) NOT IN ({listed(R.STOPWORDS)})" if screened else ""
    return f"list_filter(list_transform(string_split({name}, ' '), lambda t: trim(t, '.-')), lambda t: length(t) >= 3 AND NOT regexp_full_match(t, '[0-9]+'){extra})"


def description(i: str) -> str:
    """The text of row i by the grammar."""
    j = f"({i} // {len(G.FORMS)})"
    text = f"[{listed(G.FORMS)}][{i} % {len(G.FORMS)} + 1]"
    for slot, (words, every) in G.SLOTS.items():
        text = f"replace({text}, '{{{slot}}}', [{listed(words)}][{j} // {every} % {len(words)} + 1])"
    numbers = {"n": f"{j}::VARCHAR", "pair": f"({j} // 2)::VARCHAR", "amount": f"({j} % 400)::VARCHAR || ',' || lpad(({j} * 7 % 100)::VARCHAR, 2, '0')"}
    for slot in G.NUMBERS:
        text = f"replace({text}, '{{{slot}}}', {numbers[slot]})"
    return text


CTE: dict[str, str] = {}
CTE["ledger"] = f"""
SELECT event_id AS seq, user_id AS doc_id, event_id::VARCHAR AS transaction_id,
  CASE WHEN event_id % 11 = 0 THEN 'n/a' WHEN event_id % 7 = 0 THEN strftime(day, '%Y-%m-%d') ELSE strftime(day, '%d/%m/%Y') END AS booking_date,
  value AS amount, 'RON' AS currency, CASE WHEN event_type = 'signup' OR event_id % {len(G.FORMS)} = {G.FORMS.index(G.SALARY)} THEN 'credit' ELSE 'debit' END AS direction,
  {description('event_id')} AS raw_description,
  CASE WHEN event_type = 'error' AND k < 20 THEN 'blocked_amounts' ELSE 'booked_transactions' END AS source_section
FROM (SELECT *, json_extract_string(props, '$.k')::INT AS k, ts::DATE + ((event_id % 3)::INT * 31) AS day FROM events)"""
UPPER = "upper(coalesce(raw_description, ''))"
FEE_TEXT = f"regexp_replace({UPPER}, {s(R.FEE_FRAGMENT)}, ' ', 'gi')"
TYPE_STEPS = [
    ("source_section = 'blocked_amounts'", "BLOCKED", "blocked_amount", 0.99),
    (f"direction = 'credit' AND {has(UPPER, R.salary_hints())}", "TRANSFER", "salary_income", 0.98),
    (has(UPPER, R.ATM_HINTS), "ATM", "cash_withdrawal", 0.97),
    (has(FEE_TEXT, R.FEE_HINTS), "FEE", "bank_fee", 0.96),
    (has(UPPER, R.internal_hints()), "TRANSFER", "internal_transfer", 0.94),
    (has(UPPER, R.EXTERNAL_HINTS), "TRANSFER", "external_transfer", 0.93),
    (f"contains({UPPER}, 'EPOS')", "EPOS", "card_purchase", 0.92),
    (f"contains({UPPER}, 'POS')", "POS", "card_purchase", 0.92),
]
CTE["typed"] = f"""
SELECT *, {case([(c, s(x)) for c, x, _, _ in TYPE_STEPS], "'OTHER'")} AS channel, {case([(c, s(x)) for c, _, x, _ in TYPE_STEPS], "'unknown'")} AS txn_type,
  {case([(c, f"{x}::DOUBLE") for c, _, _, x in TYPE_STEPS], "0.55::DOUBLE")} AS confidence
FROM ledger"""

CTE["both_sides"] = """
SELECT * FROM typed UNION ALL
SELECT * REPLACE (seq + 1000000000 AS seq, transaction_id || 'm' AS transaction_id, CASE WHEN direction = 'debit' THEN 'credit' ELSE 'debit' END AS direction) FROM typed
WHERE txn_type IN ('internal_transfer', 'external_transfer') AND seq % 3 = 0"""


def cleaned() -> str:
    t = f"regexp_replace(coalesce(raw_description, ''), {s(R.URL)}, ' ', 'gi')"
    for p in [*R.REFERENCES, *R.FEE_PHRASES, R.AMOUNT_WITH_CURRENCY]:
        t = f"regexp_replace({t}, {s(p)}, ' ', 'gi')"
    t = f"regexp_replace(regexp_replace({t}, {s(R.LEADING_BOILERPLATE)}, '', 'i'), {s(R.TRAILING_NOISE)}, '', 'i')"
    return rf"nullif(trim(regexp_replace({t}, '\s+', ' ', 'g'), ' -:;,'), '')"


MERCHANT_STEPS = [(f"regexp_matches(t, {s(R.PAYMENT_GATEWAY)}, 'i')", f"regexp_extract(t, {s(R.PAYMENT_GATEWAY)}, 0, 'i')")]
MERCHANT_STEPS += [(f"regexp_matches(t, {s(p)}, 'i')", s(n)) for p, n in R.FIRST_BRANDS]
MERCHANT_STEPS += [(f"regexp_matches(t, {s(R.BRAND_WITH_SHOP)}, 'i')", rf"trim(regexp_replace(regexp_extract(t, {s(R.BRAND_WITH_SHOP)}, 0, 'i'), '\s+\d{{2,6}}.*$', ''))")]
MERCHANT_STEPS += [(f"regexp_matches(t, {s(p)}, 'i')", s(n)) for p, n in R.BRANDS]
KEPT = rf"array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(t, '[^A-Za-z0-9*./&@\s-]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda w: upper(w) NOT IN ({listed(R.TECHNICAL_TOKENS)})), ' ')"
GENERIC = f"nullif(trim(regexp_replace({KEPT}, '(?:(?:^| )(?:{'|'.join(R.LOCATION_TOKENS)}|[0-9]+))+$', '', 'i')), '')"
CTE["merchants"] = f"""
SELECT * EXCLUDE (t), CASE WHEN t IS NOT NULL THEN {case(MERCHANT_STEPS, GENERIC)} END AS merchant_raw
FROM (SELECT *, CASE WHEN txn_type IN ({listed(R.MERCHANT_TYPES)}) THEN {cleaned()} END AS t FROM typed)"""
ALIAS_ROWS = [(a, n) for n, spellings in R.ALIASES.items() for a in spellings]
CTE["aliases"] = f"SELECT {canonical('spelling')} AS alias, name FROM {table_of(ALIAS_ROWS, 'spelling', 'name')}"
CTE["norms"] = f"""
SELECT DISTINCT {canonical('m')} AS norm FROM (SELECT merchant_raw AS m FROM merchants UNION SELECT p_name FROM part) WHERE m IS NOT NULL AND m <> ''"""
CTE["own_norms"] = f"SELECT DISTINCT {canonical('merchant_raw')} AS norm FROM merchants WHERE merchant_raw IS NOT NULL AND merchant_raw <> ''"


def contained(texts: str) -> str:
    compact = "regexp_replace({}, '[^A-Z0-9]', '', 'g')"
    return f"""
SELECT norm, name AS contained_name FROM (
  SELECT norm, name, row_number() OVER (PARTITION BY norm ORDER BY length(alias) DESC, alias, name) AS k FROM (
    SELECT t.norm, a.alias, a.name, list_has_any(t.words, string_split(a.alias, ' ')) AS near FROM (SELECT norm, list_filter(string_split(norm, ' '), lambda w: length(w) >= 4) AS words FROM {texts}) t, aliases a
    QUALIFY near OR NOT bool_or(near) OVER (PARTITION BY t.norm)
  ) WHERE length(alias) >= 4 AND (contains(norm, alias) OR (regexp_matches(alias, '[*./-]') AND contains({compact.format('norm')}, {compact.format('alias')})))
) WHERE k = 1"""


CTE["contained"] = contained("own_norms")
CTE["by_pattern"] = f"""
SELECT norm, arg_min(name, priority) AS pattern_name FROM own_norms JOIN {table_of(PATTERNS[:2], 'pattern', 'name', 'priority')} ON regexp_matches(norm, pattern, 'i') GROUP BY norm"""


def named(patterns: bool, external: bool) -> str:
    steps = [("e.name IS NOT NULL", ("e.name", "alias_exact", "alias_exact", "exact_alias", 1.0)), ("c.contained_name IS NOT NULL", ("c.contained_name", "alias_contains", "alias_contains", "exact_alias", 0.98))]
    if patterns:
        steps.append(("p.pattern_name IS NOT NULL", ("p.pattern_name", "alias_regex", "alias_regex", "regex_alias", 0.96)))
    if external:
        steps.append(("x.name IS NOT NULL", ("x.name", "termene", "external_lookup", "termene_api", 0.85)))
    joins = "LEFT JOIN aliases e ON n.norm = e.alias LEFT JOIN contained c ON n.norm = c.norm"
    joins += " LEFT JOIN by_pattern p ON n.norm = p.norm" if patterns else ""
    joins += f" LEFT JOIN (SELECT * FROM {table_of(EXTERNAL, 'query_norm', 'name', 'cui', 'code')}) x ON n.norm = x.query_norm" if external else ""
    columns = [case([(c, v[k] if k == 0 else s(v[k])) for c, v in steps], d) + f" AS {n}" for k, (n, d) in enumerate([("canonical_name", "f.spelling"), ("normalization_source", "'unmapped'"), ("merchant_match_method", "'unmapped'"), ("mapping_method", "'unmapped'")])]
    columns.append(case([(c, f"{v[4]}::DOUBLE") for c, v in steps], "0.5::DOUBLE") + " AS name_confidence")
    return f"""
SELECT m.* EXCLUDE (confidence), r.canonical_name AS merchant_canonical, r.normalization_source, r.merchant_match_method, r.mapping_method, coalesce(r.name_confidence, m.confidence) AS confidence
FROM merchants m LEFT JOIN (
  SELECT n.norm, {', '.join(columns)} FROM own_norms n {joins}
  LEFT JOIN (SELECT {canonical('merchant_raw')} AS norm, arg_min(merchant_raw, seq) AS spelling FROM merchants WHERE merchant_raw <> '' GROUP BY 1) f ON n.norm = f.norm
) r ON m.merchant_raw <> '' AND r.norm = {canonical('m.merchant_raw')}"""


CTE["named"] = named(False, False)
CTE["named_all"] = named(True, True)
EXACT = mapped("trim(merchant_canonical)", R.MERCHANT_CATEGORIES)
AREA_STEPS = [
    (f"txn_type NOT IN ({listed(R.MERCHANT_TYPES)})", "NULL", "mapping_method"),
    ("coalesce(merchant_canonical, '') = ''", "'Unknown'", "'unmapped'"),
    (f"{EXACT} IS NOT NULL", EXACT, "CASE WHEN mapping_method IN ('exact_alias', 'fuzzy_alias') THEN mapping_method ELSE 'exact_alias' END"),
    *[(f"regexp_matches(merchant_canonical, {s(p)}, 'i')", s(c), "'regex_rule'") for p, c in R.CATEGORY_PATTERNS],
    (f"txn_type IN ({listed(R.CATEGORY_BY_TYPE)})", mapped("txn_type", R.CATEGORY_BY_TYPE), "'fallback_rule'"),
]


def areas(source: str) -> str:
    area, method = case([(c, a) for c, a, _ in AREA_STEPS], "'Unknown'"), case([(c, m) for c, _, m in AREA_STEPS], "'unmapped'")
    return f"SELECT * EXCLUDE (mapping_method), {area} AS category_area, {method} AS mapping_method FROM {source}"


CTE["categorised"] = areas("named")
IBAN = r"\bRO\d{2}[A-Z0-9]{10,30}\b"


def parties(source: str) -> str:
    return rf"""
SELECT *, CASE WHEN tr THEN coalesce(recipient_iban, nullif(rec, ''), nullif(left(txt, 64), '')) END AS entity_key FROM (
  SELECT *, {plain('recipient_name')} AS rec, {plain('raw_description')} AS txt FROM (
    SELECT *, CASE WHEN tr THEN nullif(upper(regexp_extract(raw_description, {s(IBAN)}, 0, 'i')), '') END AS recipient_iban, CASE WHEN tr THEN coalesce(chunks[2], chunks[1]) END AS recipient_name FROM (
      SELECT *, txn_type IN ({listed(TRANSFER_TYPES)}) AS tr, list_filter(list_transform(string_split(raw_description, ';'), lambda c: trim(c)), lambda c: c <> '') AS chunks FROM {source})))"""


def dictionary(column: str) -> str:
    """The category (or term) of the first rule that fits the text ``hay``."""
    steps = []
    for category, rule in R.TRANSFER_TERMS.items():
        negative = [t for t in map(normalised, rule["negative_terms"]) if t]
        terms = [(normalised(t), t) for t in terms_of(category) if normalised(t)]
        found = has("hay", [t for t, _ in terms])
        term = case([(f"contains(hay, {s(t)})", s(raw)) for t, raw in terms])
        steps.append((f"NOT {has('hay', negative)} AND {found}" if negative else found, s(category) if column == "category" else term))
    return case(steps)


def transferred(source: str, with_memory: bool, back: bool = True) -> tuple[str, str, str]:
    """CTE bodies: own evidence, first confirming rows, and the outcome; without ``back`` rows take nothing from later ones."""
    own = f"""
SELECT *, CASE WHEN txn_type = 'salary_income' OR (txn_type = 'external_transfer' AND d_category IS NOT NULL) THEN 'confirmed' WHEN txn_type = 'external_transfer' THEN 'unknown' END AS o_state,
  CASE WHEN txn_type = 'salary_income' THEN 'explicit_text' WHEN txn_type = 'external_transfer' AND d_category IS NOT NULL THEN 'exact_text' WHEN txn_type = 'external_transfer' THEN 'no_signal' END AS o_evidence,
  CASE WHEN txn_type = 'salary_income' OR (txn_type = 'external_transfer' AND d_category IS NOT NULL) THEN 'bootstrap_exact' WHEN txn_type = 'external_transfer' THEN 'unknown' END AS o_source,
  CASE WHEN txn_type = 'salary_income' THEN 'Other' WHEN txn_type = 'external_transfer' AND d_category IS NOT NULL THEN {mapped('d_category', AREAS)} ELSE category_area END AS o_area,
  CASE WHEN txn_type = 'external_transfer' AND d_category IS NOT NULL THEN greatest(coalesce(confidence, 0), 0.97) ELSE confidence END AS o_confidence,
  CASE WHEN txn_type = 'salary_income' THEN greatest(coalesce(confidence, 0), 0.98) ELSE greatest(coalesce(confidence, 0), 0.97) END AS o_kept,
  CASE WHEN txn_type = 'external_transfer' THEN d_term END AS o_term
FROM (SELECT *, {dictionary('category')} AS d_category, {dictionary('term')} AS d_term FROM (SELECT *, trim(concat_ws(' ', rec, txt)) AS hay FROM ({parties(source)})))"""
    first = """
SELECT entity_key, doc_id AS f_doc, seq AS f_row, o_area AS f_area, round_even(o_kept, 4) AS f_confidence, o_evidence AS f_evidence, coalesce(recipient_name, CASE WHEN txn_type = 'salary_income' THEN 'salary_income' ELSE o_term END) AS f_name, booking_date AS f_date
FROM (SELECT *, row_number() OVER (PARTITION BY entity_key ORDER BY doc_id, seq) AS k FROM own WHERE o_state = 'confirmed' AND entity_key IS NOT NULL) WHERE k = 1"""
    old = f"LEFT JOIN (SELECT * FROM {table_of(MEMORY, *MEMORY_NAMES)}) mem ON o.entity_key = mem.m_key" if with_memory else ""
    known = "mem.m_key IS NOT NULL" if with_memory else "false"
    m = (lambda c: f"mem.{c}") if with_memory else (lambda c: "NULL")
    out = f"""
SELECT * EXCLUDE (category_area, confidence), {pick("'excluded'", "'confirmed'", "'confirmed'", 'o_state')} AS state,
  {pick("'internal_transfer_filter'", f"CASE WHEN known THEN {m('m_evidence')} ELSE f_evidence END", "'entity_memory_backfill'", 'o_evidence')} AS evidence_type,
  {pick("'internal_transfer_filter'", "'entity_memory'", "'entity_memory_backfill'", 'o_source')} AS match_source,
  {pick('category_area', f"coalesce(CASE WHEN known THEN {m('m_category')} ELSE f_area END, category_area, 'Unknown')", "coalesce(f_area, category_area, 'Unknown')", 'o_area', 'category_area')} AS category_area,
  {pick('confidence', f"greatest(coalesce(confidence, 0), CASE WHEN known THEN {m('m_confidence')} ELSE f_confidence END)", 'greatest(coalesce(o_confidence, 0), f_confidence)', 'o_confidence', 'confidence')} AS confidence,
  {pick('NULL', 'NULL', 'o_term', 'o_term')} AS fuzzy_match_term, {pick('NULL', 'NULL', "CASE WHEN o_term IS NOT NULL THEN 100.0::DOUBLE END", "CASE WHEN o_term IS NOT NULL THEN 100.0::DOUBLE END")} AS fuzzy_match_score
FROM (SELECT o.*, f.* EXCLUDE (entity_key), {'mem.*, ' if with_memory else ''}{known} AS known, o.txn_type IN ('external_transfer', 'salary_income') AS active,
    coalesce(o.doc_id > f_doc OR (o.doc_id = f_doc AND o.seq > f_row), false) AS later, {'coalesce(o.doc_id = f_doc AND o.seq < f_row, false)' if back else 'false'} AS earlier
  FROM own o LEFT JOIN firsts f ON o.entity_key = f.entity_key {old})""".replace("mem.m_category", "m_category").replace("mem.m_evidence", "m_evidence").replace("mem.m_confidence", "m_confidence")
    return own, first, out


MEMORY_NAMES = ["m_key", "m_name", "m_category", "m_confidence", "m_status", "m_first", "m_last", "m_months", "m_evidence"]


def pick(internal: str, memory: str, back: str, own: str, other: str = "NULL") -> str:
    return case([("txn_type = 'internal_transfer'", internal), ("active AND (known OR later)", memory), ("active AND earlier AND o_state IN ('candidate', 'unknown')", back), ("active", own)], other)


CTE["own"], CTE["firsts"], CTE["transferred"] = transferred("categorised", False)
LOW = r"trim(regexp_replace(lower(coalesce(merchant_canonical, '')), '\s+', ' ', 'g'))"
CTE["flagged"] = f"""
SELECT *, CASE WHEN is_impulse_candidate THEN bucket END AS impulse_category, {{month}} AS statement_month FROM (
  SELECT *, coalesce(is_nonessential AND NOT is_housing AND NOT is_utility AND txn_type NOT IN ('external_transfer', 'internal_transfer', 'bank_fee') AND bucket IS NOT NULL AND abs(amount) <= {R.IMPULSE_MOST}, false) AS is_impulse_candidate FROM (
    SELECT *, txn_type = 'internal_transfer' AS is_internal_transfer, txn_type = 'salary_income' AS is_salary, final_spend_category = 'Housing' AS is_housing, {has('low', R.UTILITY_TERMS)} AS is_utility, final_spend_category IN ({listed(R.ESSENTIAL)}) AS is_essential,
      direction = 'debit' AND txn_type NOT IN ('internal_transfer', 'salary_income', 'bank_fee', 'blocked_amount', 'cash_withdrawal') AND final_spend_category NOT IN ({listed(R.ESSENTIAL)}) AS is_nonessential,
      {case([("category_area = 'Personal_Care'", "'clothing_personal_care'"), (f"low IN ({listed(m.lower() for m in R.ELECTRONICS_MERCHANTS)})", "'electronics_gadgets'"), ("category_area = 'Entertainment'", "'entertainment'"), (f"category_area = 'Food' AND low IN ({listed(m.lower() for m in R.QUICK_FOOD_MERCHANTS)})", "'food'"), ("category_area IN ('Other', 'Unknown')", "'other'")])} AS bucket
    FROM (SELECT *, coalesce(nullif(category_area, ''), 'Unknown') AS final_spend_category, {LOW} AS low FROM transferred)))"""
MONTH = "coalesce(strftime(coalesce(try_strptime(trim(booking_date), '%d/%m/%Y'), try_strptime(trim(booking_date), '%Y-%m-%d'), try_strptime(trim(booking_date), '%d-%m-%Y')), '%Y-%m'), CASE WHEN length(trim(booking_date)) >= 7 AND substr(trim(booking_date), 5, 1) = '-' THEN left(trim(booking_date), 7) END, 'unknown')"
CTE["flagged"] = CTE["flagged"].replace("{month}", MONTH)


def spent(fees: bool) -> str:
    excluded = [t for t in R.EXCLUDED_TYPES if not (fees and t == "bank_fee")]
    bucket = case([(f"trim(coalesce(merchant_canonical, '')) IN ({listed(R.ELECTRONICS_MERCHANTS)})", "'electronics_gadgets'"), ("cat = 'Personal_Care'", "'clothing_personal_care'"), ("cat = 'Entertainment'", "'entertainment'"), ("cat = 'Food'", "'food'"), ("cat IN ('Other', 'Unknown')", "'other'")])
    return f"""
SELECT *, outgo AND txn_type NOT IN ({listed(R.IMPULSE_EXCLUDED_TYPES)}) AND cat NOT IN ({listed(R.IMPULSE_EXCLUDED_CATEGORIES)}) AND money <= {R.IMPULSE_MOST} AND sbucket IS NOT NULL AND (sbucket <> 'food' OR coalesce(merchant_canonical, '') IN ({listed(R.QUICK_FOOD_MERCHANTS)})) AS impulse FROM (
  SELECT *, {bucket} AS sbucket, direction = 'debit' AND txn_type NOT IN ({listed(excluded)}) AND (txn_type <> 'external_transfer' OR (coalesce(state, '') NOT IN ('excluded', 'unknown') AND cat <> 'Unknown')) AS outgo,
    direction = 'credit' AND txn_type NOT IN ('internal_transfer', 'blocked_amount') AS income
  FROM (SELECT *, abs(amount)::DECIMAL(18, 4) AS money, coalesce(nullif(category_area, ''), 'Unknown') AS cat FROM flagged))"""


CTE["spent"], CTE["spent_fees"] = spent(False), spent(True)


def totals(*, source="spent", keys="doc_id, statement_month", group="GROUP BY doc_id, statement_month", more="") -> str:
    total = lambda c, n: f"coalesce(round(sum(money) FILTER (WHERE {c}), 2), 0)::DOUBLE AS {n}"
    count = lambda c, n: f"(count(*) FILTER (WHERE {c}))::DOUBLE AS {n}"
    columns = [total(f"outgo AND cat = {s(c)}", n) for c, n in TOTALS.items()]
    columns += [total(f"outgo AND cat NOT IN ({listed(TOTALS)})", "unknown_total"), total(f"outgo AND coalesce(merchant_canonical, '') IN ({listed(R.ELECTRONICS_MERCHANTS)})", "electronics_gadgets_total"), total("income", "income_total"), total("outgo", "outgoing_expense_total")]
    columns += [total(f"outgo AND cat IN ({listed(R.ESSENTIAL)})", "essential_total"), total(f"outgo AND cat NOT IN ({listed(R.ESSENTIAL)})", "nonessential_total"), count("outgo", "outgoing_tx_count"), count("impulse", "impulse_candidate_tx_count")]
    columns += [total(f"impulse AND sbucket = {s(b)}", f"impulse_spend_{b}") for b in R.IMPULSE_BUCKETS] + [count(f"impulse AND sbucket = {s(b)}", f"impulse_tx_count_{b}") for b in R.IMPULSE_BUCKETS]
    return f"SELECT {keys + ', ' if keys else ''}{', '.join(columns)}{more} FROM {source} {group}"


CTE["totals"] = totals()
CTE["doc_totals"] = totals(keys="doc_id", group="GROUP BY doc_id")
CTE["month_totals"] = totals(keys="statement_month", group="GROUP BY statement_month")


def shares(source: str) -> str:
    raw = ", ".join(f"CASE WHEN known > 0 THEN round_even({n} / known * 100, 4) ELSE 0 END AS r_{c}" for c, n in TOTALS.items())
    known = "0.0::DOUBLE + " + " + ".join(TOTALS.values())
    rest = " + ".join(f"r_{c}" for c in TOTALS)
    names = {c: f"Expense_Distribution_{c}" for c in TOTALS}
    best = f"list_max([{', '.join(f'{{a: {n}, c: {s(names[c])}}}' for c, n in TOTALS.items())}]).c"
    out = ", ".join(f"CASE WHEN known <= 0 THEN 0 WHEN delta <> 0 AND best = {s(names[c])} THEN round_even(greatest(0, r_{c} + delta), 4) ELSE r_{c} END AS {names[c]}" for c in TOTALS)
    return f"SELECT *, {out} FROM (SELECT *, round_even(100 - (0.0::DOUBLE + {rest}), 4) AS delta, {best} AS best FROM (SELECT *, {raw} FROM (SELECT *, {known} AS known FROM {source})))"


def winner() -> str:
    rows = []
    for k, (name, b) in enumerate(R.IMPULSE_CATEGORIES.items()):
        n, v = f"impulse_tx_count_{b}", f"impulse_spend_{b}"
        if b == "electronics_gadgets":
            n, v = (f"CASE WHEN electronics_gadgets_total > 0 THEN greatest({x}, {y}) ELSE {x} END" for x, y in ((n, "1.0"), (v, "electronics_gadgets_total")))
        rows.append(f"{{n: {n}, s: {v}, k: {-k}, c: {s(name)}}}")
    return f"list_max([{', '.join(rows)}])"


def flags() -> str:
    return ", ".join(f"""CASE WHEN (w.n > 0 OR w.s > 0) AND w.c = {s(c)} THEN 1 ELSE 0 END AS "Impulse_Buying_Category_{c}" """ for c in R.IMPULSE_CATEGORIES)


def features(source: str, keys: str) -> str:
    d = lambda *names: "round_even(" + " + ".join(["0.0::DOUBLE", *(f"Expense_Distribution_{n}" for n in names)]) + ", 4)"
    zero = lambda x, n, kind="DOUBLE": f"(CASE WHEN known + unknown_total <= 0 THEN 0 ELSE {x} END)::{kind} AS \"{n}\""
    ratio = "impulse_candidate_tx_count / outgoing_tx_count"
    band = f"CASE WHEN outgoing_tx_count > 0 THEN CASE WHEN {ratio} <= 0 THEN 0 WHEN {ratio} <= 0.20 THEN 1 WHEN {ratio} <= 0.45 THEN 2 WHEN {ratio} <= 0.75 THEN 3 ELSE 4 END ELSE 0 END"
    saves = "CASE WHEN income_total - outgoing_expense_total > 0 THEN 1 ELSE 0 END"
    columns = [f"Expense_Distribution_{c}" for c in R.DISTRIBUTION]
    columns += [zero("round_even(unknown_total / (known + unknown_total) * 100, 4)", "Unknown_Expense_Percentage"), zero(d("Food", "Housing", "Transport", "Health", "Personal_Care", "Child_Education"), "Essential_Needs_Percentage"), zero(d("Entertainment", "Other"), "Discretionary_Spending_Percentage")]
    columns += [zero(f"1 - {saves}", "Save_Money_No", "INT"), zero(saves, "Save_Money_Yes", "INT"), zero(band, "Impulse_Buying_Frequency", "INT")]
    columns += [zero(f"CASE WHEN (w.n > 0 OR w.s > 0) AND w.c = {s(c)} THEN 1 ELSE 0 END", f"Impulse_Buying_Category_{c}", "INT") for c in R.IMPULSE_CATEGORIES]
    return f"SELECT {keys}, {', '.join(columns)} FROM (SELECT *, {winner()} AS w FROM ({shares(source)}))"


CTE["features"] = features("totals", "doc_id, statement_month")
CTE["pages"] = "SELECT source AS doc_id, doc_id AS page_no, text FROM documents"
BREAK = LINE_BREAK
CTE["page_lines"] = rf"""
SELECT doc_id, page_no, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS line_no FROM (
  SELECT doc_id, page_no, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), {s(BREAK)}), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM pages)"""
NOISE = rf"regexp_matches(line, '\b(?:{'|'.join(R.LINE_NOISE)})\b', 'i')"
KEY = r"regexp_replace(lower(line), '\d+', '#', 'g')"
PROFILE_MODEL = "0.25"

DATED = f"regexp_matches(booking_date, {s(R.DATE_START)})"
CTE["statement_lines"] = f"""
SELECT doc_id, 2 * seq AS line_no, CASE WHEN seq % 97 = 0 THEN 'SUME BLOCATE' WHEN seq % 89 = 0 THEN 'TRANZACTII EFECTUATE' WHEN seq % 53 = 0 THEN date || ' RULAJ ZI 1,00'
  WHEN seq % 13 = 0 THEN '- ' || body || ' aferenta tranzactiei ' || date WHEN seq % 5 = 0 THEN body ELSE date || ' ' || body END AS line
FROM (SELECT *, CASE WHEN {DATED} THEN booking_date ELSE '09/09/2024' END AS date, raw_description || ' ' || printf('%.2f', amount) AS body FROM ledger)
UNION ALL SELECT doc_id, 2 * seq + 1, 'continuare ' || seq::VARCHAR || CASE WHEN seq % 6 = 0 THEN ' CREDIT 12,50' ELSE '' END FROM ledger WHERE seq % 3 = 0"""
HEADER = case([(has("upper(line)", R.BLOCKED_HEADERS), "'blocked_amounts'"), (has("upper(line)", [*R.TABLE_HEADERS, *R.BOOKED_HEADERS]), "'booked_transactions'")])
CTE["candidates"] = f"""
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY run, entry) AS candidate, section, text FROM (
  SELECT doc_id, run, entry, min(section) AS section, string_agg(CASE WHEN start AND NOT dated AND carried IS NOT NULL AND NOT regexp_matches(line, {s(R.DATE)}) THEN carried || ' ' || line ELSE line END, ' ' ORDER BY line_no) AS text FROM (
    SELECT *, count(*) FILTER (WHERE start) OVER (PARTITION BY doc_id, run ORDER BY line_no) AS entry,
      last_value(CASE WHEN dated THEN left(line, 10) END IGNORE NULLS) OVER (PARTITION BY doc_id, blocked_run ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS carried FROM (
      SELECT *, dated OR CASE WHEN section = 'blocked_amounts' THEN starts_with(trim(line), '-') AND contains(upper(line), {s(R.BLOCKED_ENTRY)}) AND regexp_matches(line, {s(R.DATE)}) ELSE {' OR '.join(f'starts_with(upper(trim(line)), {s(h)})' for h in R.ENTRY_STARTS)} END AS start FROM (
        SELECT *, last_value(event IGNORE NULLS) OVER d AS section, count(header) OVER d AS run, count(*) FILTER (WHERE header = 'blocked_amounts') OVER d AS blocked_run FROM (
          SELECT *, coalesce(header, CASE WHEN count(header) OVER d = 0 AND dated AND NOT noisy THEN 'booked_transactions' END) AS event FROM (
            SELECT *, {HEADER} AS header, regexp_matches(line, {s(R.DATE_START)}) AS dated, {has('upper(line)', R.DATED_NOISE)} AS noisy FROM statement_lines)
          WINDOW d AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
        WINDOW d AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
      WHERE header IS NULL AND section IS NOT NULL)
    WHERE NOT (start AND noisy))
  WHERE entry > 0 GROUP BY doc_id, run, entry)"""


def amount_of(t: str) -> str:
    both = f"CASE WHEN length({t}) - strpos(reverse({t}), ',') > length({t}) - strpos(reverse({t}), '.') THEN replace(replace({t}, '.', ''), ',', '.') ELSE replace({t}, ',', '') END"
    only = f"CASE WHEN regexp_full_match({t}, '[^,]*,[^,]{{3}}') THEN replace({t}, ',', '') ELSE replace({t}, ',', '.') END"
    return f"try_cast(CASE WHEN contains({t}, ',') AND contains({t}, '.') THEN {both} WHEN contains({t}, ',') THEN {only} ELSE {t} END AS DOUBLE)"


def described(text: str, date: str) -> str:
    return rf"trim(regexp_replace(substr({text}, 1, strpos({text}, {date}) - 1) || ' ' || substr({text}, strpos({text}, {date}) + length({date})), '\s+', ' ', 'g'), ' -:;')"


def entry_id(number: str, date: str, amount: str, direction: str, text: str, section: str) -> str:
    return f"'TXN-' || lpad({number}::VARCHAR, greatest(6, length({number}::VARCHAR))::INT, '0') || '-' || left(sha1(concat_ws('|', {number}::VARCHAR, {date}, printf('%.2f', {amount}), {direction}, {text}, {section})), 10)"


def first_amount(t: str) -> str:
    return f"nullif(regexp_extract({t}, {s('(' + R.AMOUNT + ')')}, 1), '')"


def after(words: str) -> str:
    return rf"nullif(regexp_extract(text, '\b(?:{words})\b[^\d+-]{{0,12}}({R.AMOUNT})', 1, 'i'), '')"


CTE["parsed"] = rf"""
SELECT * FROM (
  SELECT *, CASE WHEN section = 'blocked_amounts' THEN abs({amount_of('any_amount')}) WHEN {amount_of('debit_text')} IS NOT NULL THEN abs({amount_of('debit_text')}) WHEN {amount_of('credit_text')} IS NOT NULL THEN abs({amount_of('credit_text')}) ELSE abs({amount_of('open_text')}) END AS amount,
    CASE WHEN section = 'blocked_amounts' OR {amount_of('debit_text')} IS NOT NULL THEN 'debit' WHEN {amount_of('credit_text')} IS NOT NULL OR starts_with(open_text, '+') THEN 'credit' WHEN starts_with(open_text, '-') THEN 'debit' WHEN {has('upper(text)', R.CREDIT_WORDS)} THEN 'credit' ELSE 'debit' END AS direction,
    coalesce(nullif(upper(regexp_extract(text, {s(R.CURRENCY)}, 1, 'i')), ''), 'RON') AS currency, {described('text', 'booking_date')} AS raw_description
  FROM (SELECT *, nullif(regexp_extract(text, {s(R.DATE)}, 1), '') AS booking_date, {first_amount('text')} AS any_amount, {after('DEBIT|DB')} AS debit_text, {after('CREDIT|CR')} AS credit_text, {first_amount(rf"regexp_replace(text, '\b(?:SOLD|BALANCE)\b.*$', '', 'is')")} AS open_text FROM candidates)
  WHERE booking_date IS NOT NULL)
WHERE amount IS NOT NULL"""

CTE["firm_list"] = "SELECT min(p_partkey) AS firm_id, p_name AS name FROM part GROUP BY p_name"
CTE["wanted"] = "SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN string_split(p_name, ' ')[-1] || ' stores' ELSE lower(p_type) END AS query FROM part"
CTE["best_firm"] = f"""
SELECT query, -m.k AS firm_id, m.score AS score FROM (
  SELECT query, max({{score: score, k: -firm_id}}) AS m FROM (
    SELECT query, firm_id, CASE WHEN contains(f_norm, q_norm) THEN greatest(base, 0.97) ELSE base END AS score FROM (
      SELECT *, 0.65 * (overlap / len(q_tokens)) + 0.35 * (overlap / greatest(1, len(f_tokens))) AS base FROM (
        SELECT *, CASE WHEN len(list_intersect(q_tokens, f_tokens)) > 0 THEN len(list_intersect(q_tokens, f_tokens)) WHEN list_has_any(q_pre, f_pre) THEN 1 ELSE 0 END::DOUBLE AS overlap
        FROM (SELECT *, list_transform(list_filter(q_tokens, lambda t: length(t) >= 4), lambda t: left(t, 4)) AS q_pre FROM (SELECT query, {registry_name('query')} AS q_norm, list_distinct({tokens(registry_name('query'), False)}) AS q_tokens FROM wanted)),
          (SELECT *, list_transform(list_filter(f_tokens, lambda t: length(t) >= 4), lambda t: left(t, 4)) AS f_pre FROM (SELECT firm_id, {registry_name('name')} AS f_norm, list_distinct({tokens(registry_name('name'), False)}) AS f_tokens FROM firm_list)))
      WHERE overlap > 0))
  GROUP BY query) WHERE m.score >= 0.5"""
CTE["model"] = "SELECT vec_id, label, list_transform(embedding, lambda x, i: CASE WHEN i <= 8 THEN (x::DOUBLE - 0.01) / 0.1 ELSE x::DOUBLE END) AS x FROM embeddings"
CTE["weights"] = f"SELECT [{', '.join(f'{w}::DOUBLE' for w in WEIGHTS)}] AS w"
CTE["scored"] = """
SELECT vec_id, label, x, least(1, greatest(0, round_even(1 - saving, 6))) AS risk_score, round_even(least(1, greatest(0, saving)), 6) AS saving_probability
FROM (SELECT *, 1 / (1 + exp(-z)) AS saving FROM (SELECT *, list_sum(list_transform(x, lambda v, i: v * w[i])) + 0.25 AS z FROM model, weights))"""
def linear(x: str, b: float = 0.25) -> str:
    """The score of a list of numbers."""
    return f"1 / (1 + exp(-(list_sum(list_transform({x}, lambda v, i: v * w[i])) + {b})))"


CTE["vectors"] = "SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings"
CTE["month_weights"] = f"SELECT [{', '.join(f'{w}::DOUBLE' for w in MONTH_WEIGHTS)}] AS w"
CTE["contributions"] = "SELECT vec_id, label, i, printf('f%02d', i - 1) AS f, v * w[i] AS c FROM (SELECT vec_id, label, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM model), weights"
LEVEL = f"CASE WHEN risk_score < {R.HEALTHY_BELOW} THEN 'healthy' WHEN risk_score < {R.RISKY_FROM} THEN 'moderate' ELSE 'risky' END"
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
PRIORITIES = {"1-URGENT": 4.0, "2-HIGH": 3.0, "3-MEDIUM": 2.0, "4-NOT SPECIFIED": 1.0, "5-LOW": 0.0}
CTE["answers"] = "SELECT c_custkey, c_mktsegment, list_sort(list(DISTINCT o_orderstatus)) AS statuses, max(o_orderpriority) AS priority FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL"


def seven(*gone: int) -> str:
    """The vector with its first numbers (those of the scaled features) scaled, but for some places."""
    some = ", ".join(str(k) for k in range(1, len(R.SCALED_FEATURES) + 1) if k not in gone)
    return f"list_transform(x, lambda v, i: CASE WHEN i IN ({some}) THEN (v - 0.01) / 0.1 ELSE v END)"


def month_value(c: str) -> str:
    v = f'coalesce("{c}", 0)::DOUBLE'
    return {"Essential_Needs_Percentage": f"({v} - 50.0) / 20.0", "Income_Category": f"({v} - 1000.0) / 2000.0"}.get(c, v)


# Firms by name and by set of tokens; the smallest number wins.
CTE["firm_names"] = f"""
SELECT firm_id, trim(name) AS display, {registry_name('trim(name)')} AS norm, list_sort(list_distinct({tokens(registry_name('trim(name)'), True)})) AS own FROM (
  SELECT * FROM firm_list UNION ALL SELECT min(seq) + 1000000000, merchant_raw || ' SRL' FROM merchants WHERE merchant_raw <> '' AND seq % 2 = 0 GROUP BY merchant_raw)"""
CTE["exact_firms"] = f"""
SELECT *, concat_ws(' ', dataset, query) AS both_names, array_to_string(list_transform(list_filter(string_split(dataset, ' '), lambda t: t <> '' AND t NOT IN ({listed(LEGAL_NOISE)}))[1:2], lambda t: upper(left(t, 1)) || lower(t[2:])), ' ') AS short FROM (
  SELECT n.query, coalesce(a.display, b.display) AS display, {canonical('coalesce(a.display, b.display)')} AS dataset
  FROM (SELECT norm AS query, {registry_name('norm')} AS n, list_sort(list_distinct({tokens(registry_name('norm'), True)})) AS own FROM norms) n
  LEFT JOIN (SELECT norm, arg_min(display, firm_id) AS display FROM firm_names WHERE len(own) > 0 GROUP BY norm) a ON n.n = a.norm
  LEFT JOIN (SELECT own, arg_min(display, firm_id) AS display FROM firm_names WHERE len(own) > 0 GROUP BY own) b ON n.own = b.own
  WHERE len(n.own) > 0 AND coalesce(a.display, b.display) IS NOT NULL)"""
CTE["firm_texts"] = "SELECT DISTINCT both_names AS norm FROM exact_firms"


def pick_of(labels, by: str) -> str:
    labels = list(labels)
    return f"[{listed(labels)}][({by}) % {len(labels)} + 1]"


def answers_of() -> dict[str, str]:
    """Each question's answer, by the rule of the queries' stand-in profiles; several chosen ones as a list."""
    out = {g: pick_of(o, f"c_custkey + {k}") for k, (g, o) in enumerate(R.QUESTIONS.items())}
    out |= {g: f"list_distinct([{pick_of(o, 'c_custkey')}] || CASE WHEN c_custkey % 2 = 0 THEN [{pick_of(o, 'c_custkey + 1')}] ELSE [] END)" for g, o in R.MULTI_QUESTIONS.items()}
    return out | {g: pick_of(steps, f"c_custkey + {k}") for k, (g, (_, steps)) in enumerate(R.ORDINAL_QUESTIONS.items())}


CTE["answered"] = "SELECT c_custkey, " + ", ".join(f'{v} AS "{g}"' for g, v in answers_of().items()) + " FROM customer"


def profile_values() -> dict[str, str]:
    out = {f: f'("{g}" = {s(label)})::INT::DOUBLE' for g, options in R.QUESTIONS.items() for label, f in options.items()}
    out |= {f: f'list_contains("{g}", {s(label)})::INT::DOUBLE' for g, options in R.MULTI_QUESTIONS.items() for label, f in options.items()}
    out |= {name: f'({case([(f"{chr(34)}{g}{chr(34)} = {s(label)}", f"{v}::DOUBLE") for label, v in steps.items()])})' for g, (name, steps) in R.ORDINAL_QUESTIONS.items()}
    for k, n in enumerate(R.NUMERIC_FEATURES):
        number = f"(20 + (c_custkey + {k}) % 40)::DOUBLE"
        out[n] = f"CASE WHEN c_custkey % 5 = 0 THEN 0::DOUBLE ELSE {number} END" if n in R.LIFETIMES else number
    return out


def used(sql: str) -> list[str]:
    """The CTEs that a text needs, in order of definition."""
    import re

    names, todo = set(), [sql]
    while todo:
        text = todo.pop()
        for name in CTE:
            if name not in names and re.search(rf"(?<![.\w]){name}(?!\w)", text):
                names.add(name)
                todo.append(CTE[name])
    order, done = [], set()

    def visit(name: str) -> None:
        if name in done:
            return
        done.add(name)
        for other in CTE:
            if other != name and other in names and re.search(rf"(?<![.\w]){other}(?!\w)", CTE[name]):
                visit(other)
        order.append(name)

    for name in CTE:
        if name in names:
            visit(name)
    return order


def q(sql: str, **more: str) -> str:
    saved = {k: CTE.get(k) for k in more}
    CTE.update(more)
    try:
        names = used(sql)
        return ("WITH " + ",\n".join(f"{n} AS ({CTE[n]})" for n in names) + "\n" if names else "") + sql
    finally:
        for k, v in saved.items():
            if v is None:
                CTE.pop(k)
            else:
                CTE[k] = v


def counts(pairs: dict[str, str]) -> str:
    return ", ".join(f"count(*) FILTER (WHERE {c}) AS {n}" for n, c in pairs.items())


def rate(a: str, b: str) -> str:
    return f"coalesce(round_even(({a}) / nullif(({b})::DOUBLE, 0), 4), 0)"


def dense() -> str:
    """The dense model layer by layer, over unnested weights."""
    steps = ["n0 AS (SELECT vec_id, unnest(range(64)) AS j, unnest(list_transform(embedding::DOUBLE[], lambda v, k: CASE WHEN k <= 8 THEN (v - 0.01) / 0.1 ELSE v END)) AS x FROM embeddings)"]
    for k, (name, wide, deep, rule) in enumerate(NET):
        trunk = name.startswith("shared_trunk")
        source = f"n{k}" if trunk else f"n{sum(n.startswith('shared_trunk') for n, *_ in NET)}"
        value = f"sum(({rule})::DOUBLE * x) + ({BIAS})::DOUBLE"
        value = f"greatest(0, {value})" if trunk else f"1 / (1 + exp(-({value})))"
        steps.append(f"n{k + 1} AS (SELECT vec_id, i AS j, {value} AS x FROM {source}, (SELECT unnest(range({wide})) AS i) GROUP BY vec_id, i)")
    heads = [k + 1 for k, (n, *_) in enumerate(NET) if not n.startswith("shared_trunk")]
    return f"WITH {', '.join(steps)} SELECT vec_id, round_even(a.x, 6) AS risk_score, round_even(b.x, 6) AS saving_probability FROM n{heads[0]} a JOIN n{heads[1]} b USING (vec_id)"


def oracle_sql() -> dict[str, str]:
    eligible, unknown = f"count(*) FILTER (WHERE txn_type IN ({listed(R.MERCHANT_TYPES)}))", f"count(*) FILTER (WHERE txn_type IN ({listed(R.MERCHANT_TYPES)}) AND category_area = 'Unknown')"
    valid = "count(*) FILTER (WHERE txn_type <> 'unknown')"
    tr = f"txn_type IN ({listed(TRANSFER_TYPES)})"
    late = f"CASE WHEN {LATE} THEN raw_description || '; chirie' ELSE raw_description END"
    own, firsts, outcome = transferred("late_rows", True)
    memory = {"late_rows": f"SELECT * EXCLUDE (raw_description), {late} AS raw_description, NULL::VARCHAR AS category_area FROM typed", "own": own, "firsts": firsts, "transferred": outcome}
    final = []
    for c in R.final_columns():
        kind = "VARCHAR" if c == "Behavior_Risk_Level" else "DOUBLE" if c in R.REAL_COLUMNS else "INT"
        value = "income" if c == "Income_Category" else f"(f.\"{c}\" >= {R.DISTRIBUTION_LEAST})::INT" if c.startswith("Expense_Distribution_") else f'f."{c}"' if c in R.feature_columns() else "l.quality" if c == "Gender_Female" else "NULL"
        final.append(f'({value})::{kind} AS "{c}"')
    values, assembled = profile_values(), []
    for c in MONTH_COLUMNS:
        value = "1000.0::DOUBLE" if c == "Income_Category" else f'("{c}" >= {R.DISTRIBUTION_LEAST})::INT::DOUBLE' if c.startswith("Expense_Distribution_") else f'"{c}"::DOUBLE' if c in R.feature_columns() else values.get(c, "0::DOUBLE")
        if c.startswith("Savings_Obstacle_"):
            value = f'CASE WHEN coalesce("Save_Money_Yes", 0) >= 0.5 THEN 0 ELSE {value} END'
        assembled.append(f'{value} AS "{c}"')
    money = "coalesce(round(sum(abs(amount)::DECIMAL(18, 4)) FILTER (WHERE txn_type = 'salary_income' AND direction = 'credit'), 2), 0)::DOUBLE"
    ref = r"nullif(upper(regexp_extract(coalesce(raw_description, ''), '\bREF\s*[:=]?\s*([A-Z0-9-]+)', 1, 'i')), '')"
    desc = r"trim(regexp_replace(upper(coalesce(raw_description, '')), '\s+', ' ', 'g'))"
    metric = lambda c, *names: f"{tr} AND {c} IN ({listed(names)})"
    top = lambda where, order: f"(SELECT vec_id, string_agg(f || ':' || printf('%.6f', round_even(c, 6)), ',' ORDER BY {order}, i) AS t FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY {order}, i) AS k FROM contributions WHERE {where}) WHERE k <= 5 GROUP BY vec_id)"
    code = "lpad(left(nullif(regexp_replace(code, '\\D', '', 'g'), ''), 4), 4, '0')"
    category = f"coalesce({mapped('n', R.CODE_CATEGORY)}, {mapped('left(n, 2)', R.PREFIX_CATEGORY)})"
    ranks = mapped("c", {c: k for k, c in enumerate(R.PRIMARY_ORDER)})
    rules = [("risk_score >= 0.7", "high_risk_score"), ("saving_probability < 0.5", "low_saving_probability")] + [(f"{r['metric']} {r['operator']} {r['value']}", r.get("message") or f"rule:{r['metric']}") for r in RULES]
    out = {
        "ledger_adapter": "SELECT * FROM ledger",
        "month_key": f"SELECT seq, booking_date, {MONTH} AS statement_month FROM ledger",
        "txn_type_cascade": "SELECT seq, channel, txn_type, confidence FROM typed",
        "txn_type_summary": f"SELECT doc_id, count(*) AS total, {valid} AS valid, {rate(valid, 'count(*)')} AS valid_rate FROM typed GROUP BY doc_id",
        "merchant_extract": "SELECT seq, merchant_raw FROM merchants",
        "alias_exact_join": "SELECT norm, name AS exact_name FROM norms JOIN aliases ON norm = alias",
        "alias_contains_join": f"SELECT * FROM ({contained('norms')})",
        "alias_regex_join": f"SELECT norm, arg_min(name, priority) AS pattern_name FROM norms JOIN {table_of(PATTERNS, 'pattern', 'name', 'priority')} ON regexp_matches(norm, pattern, 'i') GROUP BY norm",
        "normalise_cascade": "SELECT seq, merchant_canonical, normalization_source, merchant_match_method, mapping_method, confidence FROM named_all",
        "category_map": "SELECT seq, merchant_canonical, category_area, mapping_method FROM categorised",
        "category_summary": f"SELECT doc_id, {eligible} AS eligible_for_category, {unknown} AS unknown_category, {rate(unknown, eligible)} AS unknown_rate, "
        + counts({"merchant_extracted": "coalesce(merchant_raw, '') <> ''", "merchant_normalized": "coalesce(merchant_canonical, '') <> ''", "merchant_normalized_from_dataset": "normalization_source = 'dataset'", "merchant_normalized_from_external": "normalization_source = 'termene'", "merchant_normalized_from_alias": "starts_with(normalization_source, 'alias_')", "merchant_normalized_unmapped": "normalization_source = 'unmapped'", "transfer_candidate_count": "state = 'candidate'", "transfer_bootstrap_exact_hits": "match_source = 'bootstrap_exact'", "transfer_bootstrap_fuzzy_hits": "match_source = 'bootstrap_fuzzy'"})
        + " FROM flagged GROUP BY doc_id",
        "row_flags": "SELECT seq, final_spend_category, is_essential, is_nonessential, is_internal_transfer, is_salary, is_housing, is_utility, is_impulse_candidate, impulse_category FROM flagged",
        "expense_totals": "SELECT * FROM totals",
        "expense_totals_with_fees": totals(source="spent_fees"),
        "expense_totals_rollup": totals(group="GROUP BY GROUPING SETS ((doc_id, statement_month), (doc_id))"),
        "distribution_percent": f"SELECT doc_id, statement_month, {', '.join(f'Expense_Distribution_{c}::DOUBLE AS Expense_Distribution_{c}' for c in TOTALS)} FROM ({shares('totals')})",
        "feature_vector_month": "SELECT * FROM features",
        "impulse_winner": f"SELECT doc_id, statement_month, {flags()} FROM (SELECT *, {winner()} AS w FROM totals)",
        "final_row_month": f"SELECT f.doc_id, f.statement_month, {', '.join(final)} FROM features f JOIN (SELECT doc_id, statement_month, {money} AS income FROM flagged GROUP BY ALL) i ON f.doc_id = i.doc_id AND f.statement_month = i.statement_month LEFT JOIN labels l ON f.doc_id = l.doc_id",
        "salary_metrics": f"SELECT doc_id, count(*) FILTER (WHERE txn_type = 'salary_income' AND direction = 'credit') > 0 AS salary_income_detected, count(*) FILTER (WHERE txn_type = 'salary_income' AND direction = 'credit') AS salary_income_count, {money} AS salary_income_total FROM flagged GROUP BY doc_id",
        "transfer_metrics": "SELECT doc_id, "
        + counts({"entity_memory_hits": metric("match_source", "entity_memory", "entity_memory_backfill"), "entity_memory_direct_hits": metric("match_source", "entity_memory"), "entity_memory_backfill_hits": metric("match_source", "entity_memory_backfill"), "bootstrap_exact_hits": metric("match_source", "bootstrap_exact"), "bootstrap_fuzzy_hits": metric("match_source", "bootstrap_fuzzy"), "candidate_count": metric("state", "candidate"), "confirmed_by_memory": metric("match_source", "entity_memory", "entity_memory_backfill") + " AND state = 'confirmed'", "confirmed_by_recurrence": metric("match_source", "recurrence") + " AND state = 'confirmed'", "backfilled_transactions": metric("match_source", "entity_memory_backfill"), "remaining_unknown_transfers": metric("state", "unknown", "candidate")})
        + " FROM flagged GROUP BY doc_id",
        "kpi_block": f"SELECT doc_id, true AS save_money_computed, impulse_candidate_tx_count::BIGINT AS impulse_candidates_count, coalesce(round_even(impulse_candidate_tx_count / nullif(outgoing_tx_count, 0), 4), 0) AS impulse_frequency, {', '.join(f'impulse_tx_count_{b}::BIGINT AS impulse_count_{b}' for b in R.IMPULSE_BUCKETS)}, housing_total AS housing_detected_amount, unknown_transfer_count, round_even(Expense_Distribution_Other, 4) AS other_spend_share FROM ({shares('kpi_totals')})",
        "quality_metrics": "SELECT doc_id, count(*) AS transactions_extracted_count, "
        + counts({"booked_transactions_count": "source_section = 'booked_transactions'", "blocked_transactions_count": "source_section = 'blocked_amounts'", "merchant_extracted_count": f"txn_type IN ({listed(R.MERCHANT_TYPES)}) AND coalesce(merchant_raw, '') <> ''", "merchant_unknown_count": f"txn_type IN ({listed(R.MERCHANT_TYPES)}) AND coalesce(merchant_raw, '') = ''", "category_unknown_count": f"txn_type IN ({listed(R.MERCHANT_TYPES)}) AND category_area = 'Unknown'"})
        + " FROM flagged GROUP BY doc_id",
        "label_accuracy": "SELECT round_even(avg(((n_chars > 200)::INT = l.quality)::INT), 4) AS quality_accuracy, round_even(avg((0 = l.toxic)::INT), 4) AS toxic_accuracy FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
        "summary_merge": f"SELECT doc_id, count(*) AS total, {valid} AS valid, {unknown} AS unknown_category, round_even({valid} / count(*)::DOUBLE, 4) AS valid_rate, round_even({unknown} / count(*)::DOUBLE, 4) AS unknown_rate FROM flagged GROUP BY doc_id",
        "profile_hash": f"SELECT doc_id, 'profile-' || left(sha256(coalesce(string_agg(iban, '|' ORDER BY iban), doc_id::VARCHAR)), 12) AS profile_id FROM (SELECT DISTINCT doc_id, upper(nullif(regexp_extract(raw_description, {s(IBAN)}, 0, 'i'), '')) AS iban FROM ledger) GROUP BY doc_id",
        "dedup_exact": f"SELECT seq, transaction_id, booking_date, amount FROM (SELECT *, row_number() OVER (PARTITION BY booking_date, round_even(amount, 2), direction, source_section, {desc} ORDER BY seq) AS k FROM (SELECT * FROM ledger UNION ALL SELECT * REPLACE (seq + 1000000000 AS seq) FROM ledger)) WHERE k = 1",
        "dedup_stream": f"SELECT DISTINCT ON (booking_date, round_even(amount, 2), direction, source_section, {desc}) booking_date, amount, direction, source_section, raw_description FROM ledger",
        "dedup_mirror": "SELECT CASE WHEN ref IS NULL THEN seq ELSE place END AS seq, transaction_id, direction, txn_type FROM tied WHERE ref IS NULL OR k = 1",
        "removed_ids": f"SELECT transaction_id, seq, 'repeat' AS reason FROM once WHERE r > 1 UNION ALL SELECT transaction_id, seq, 'mirror' FROM tied WHERE ref IS NOT NULL AND k > 1",
        "split_lines": "SELECT page_no, line_no, line FROM page_lines",
        "line_keys": f"SELECT {KEY} AS key, count(*) AS n, count(*) FILTER (WHERE {NOISE}) AS noise FROM page_lines GROUP BY 1",
        "header_footer_removal": f"SELECT l.doc_id, l.page_no, l.line_no, l.line FROM edged l WHERE NOT {NOISE} AND NOT EXISTS (SELECT 1 FROM (SELECT doc_id, key FROM (SELECT doc_id, key FROM edged WHERE up <= 4 UNION ALL SELECT doc_id, key FROM edged WHERE down <= 4) GROUP BY ALL HAVING count(*) >= 2) g WHERE g.doc_id = l.doc_id AND g.key = l.key)",
        "statement_candidates": "SELECT * FROM candidates",
        "statement_parse": f"SELECT doc_id, candidate AS seq, {entry_id('candidate', 'booking_date', 'amount', 'direction', 'raw_description', 'section')} AS transaction_id, booking_date, amount, currency, direction, raw_description, section AS source_section FROM parsed",
        "amount_parse": f"SELECT literal, {amount_of('l')} AS amount FROM (SELECT literal, ltrim(literal, '+-') AS l FROM (SELECT literal FROM {table_of([(x,) for x in LITERALS], 'literal')} UNION SELECT CASE p_partkey % 4 WHEN 0 THEN printf('%.2f', p_retailprice) WHEN 1 THEN replace(printf('%.2f', p_retailprice), '.', ',') WHEN 2 THEN format('{{:,.2f}}', p_retailprice) ELSE '-' || translate(format('{{:,.2f}}', p_retailprice), ',.', '.,') END FROM part))",
        "transaction_id": f"SELECT seq, d AS raw_description, {entry_id('seq', 'booking_date', 'amount', 'direction', 'd', 'source_section')} AS id FROM (SELECT *, {described('whole', 'booking_date')} AS d FROM (SELECT *, booking_date || ' ' || raw_description AS whole FROM ledger))",
        "registry_tokens": f"SELECT name, array_to_string(list_sort(list_distinct({tokens('n', True)})), '|') AS screened, array_to_string(list_sort(list_distinct({tokens('n', False)})), '|') AS tokens, array_to_string(list_transform(list_sort(list_transform(list_filter(k, lambda t, i: list_position(k, t) = i), lambda t, i: {{b: CASE WHEN left(t, 4) IN ({listed(R.BRAND_PREFIXES)}) THEN 0 ELSE 1 END, l: -length(t), i: i, t: t}}))[1:3], lambda x: x.t), '|') AS important FROM (SELECT *, {tokens('n', True)} AS k FROM (SELECT name, {registry_name('name')} AS n FROM (SELECT s_name AS name FROM supplier UNION SELECT p_name || ' SRL Romania ' || p_type FROM part)))",
        "registry_blocking": f"SELECT query, firm_id, block_score, block_rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY block_score DESC, firm_id) AS block_rank FROM (SELECT query, firm_id, sum(w)::BIGINT AS block_score FROM (SELECT query, firm_id, CASE WHEN a = b THEN 3 ELSE 0 END + CASE WHEN length(a) >= 4 AND length(b) >= 4 AND left(a, 4) = left(b, 4) THEN 1 ELSE 0 END AS w FROM (SELECT query, unnest(list_distinct({tokens(registry_name('query'), True)})) AS a FROM wanted), (SELECT firm_id, unnest(list_distinct({tokens(registry_name('name'), True)})) AS b FROM firm_list)) WHERE w > 0 GROUP BY ALL)) WHERE block_rank <= {R.REGISTRY_CANDIDATES}",
        "registry_topk_match": "SELECT query, firm_id, round_even(score, 6) AS score FROM best_firm",
        "registry_code_join": f"SELECT firm, code, description, coalesce({mapped('code', R.INDUSTRY_OVERRIDES)}, description, {s(R.UNKNOWN_INDUSTRY)}) AS industry FROM (SELECT DISTINCT l_suppkey AS firm, lpad(l_partkey::VARCHAR, greatest(4, length(l_partkey::VARCHAR))::INT, '0') AS code FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) LEFT JOIN (SELECT lpad(p_partkey::VARCHAR, 4, '0') AS class, arg_min(p_name, p_partkey) AS description FROM part GROUP BY 1) ON class = code",
        "registry_resolve": f"SELECT w.query, CASE WHEN b.query IS NOT NULL THEN 'onrc' WHEN x.name IS NOT NULL THEN 'termene' ELSE 'not_found' END AS source, coalesce(f.name, x.name) AS name, coalesce(f.firm_id::VARCHAR, x.cui) AS cui FROM wanted w LEFT JOIN best_firm b ON w.query = b.query LEFT JOIN firm_list f ON b.firm_id = f.firm_id LEFT JOIN (SELECT * FROM (VALUES ('COLD STORES', 'Cold Stores', '77'), ('ECONOMY', 'Economy Trade', '78')) v(query_norm, name, cui)) x ON b.query IS NULL AND {registry_name('w.query')} = x.query_norm",
        "primary_code_category": f"SELECT l_suppkey, arg_min(c, (-k * 1000 + coalesce({ranks}::INT, 999))) FILTER (WHERE c IS NOT NULL) AS primary_category FROM (SELECT l_suppkey, {category} AS c, count(*) AS k FROM (SELECT l_suppkey, {code} AS n FROM (SELECT l_suppkey, (l_partkey * 7 + 1000)::VARCHAR AS code FROM lineitem)) GROUP BY ALL) GROUP BY l_suppkey",
        "code_tables": f"SELECT code, n AS normalised, {category} AS category, coalesce({mapped('n', R.CODE_IMPULSE)}, {mapped('left(n, 2)', R.PREFIX_IMPULSE)}, 'Other') AS impulse, {mapped('n', R.CODE_LIFETIME)} AS lifetime FROM (SELECT code, {code} AS n FROM (SELECT DISTINCT (l_partkey * 7 + 1000)::VARCHAR AS code FROM lineitem))",
        "transfer_exact_terms": f"SELECT seq, recipient_iban, recipient_name, entity_key, {dictionary('category')} AS category, {dictionary('term')} AS term FROM (SELECT *, trim(concat_ws(' ', rec, txt)) AS hay FROM ({parties('typed')})) WHERE tr",
        "onehot_encode": f"SELECT c_custkey, {', '.join(f'(c_mktsegment = {s(x)})::INT::DOUBLE AS Segment_{x.title()}' for x in SEGMENTS)}, {', '.join(f'list_contains(statuses, {s(x)})::INT::DOUBLE AS Status_{x}' for x in 'FOP')}, ({mapped('priority', PRIORITIES)})::DOUBLE AS \"Priority\" FROM answers",
        "onehot_decode": "SELECT c_custkey, c_mktsegment AS segment, array_to_string(statuses, '; ') AS statuses, priority FROM answers",
        "scale_score": f"SELECT vec_id, risk_score, saving_probability, {LEVEL} AS risk_level FROM (SELECT vec_id, round_even(1 - p, 6) AS risk_score, round_even(p, 6) AS saving_probability FROM (SELECT vec_id, {linear(seven())} AS p FROM vectors, weights))",
        "scaler_widths": " UNION ALL ".join(f"SELECT '{name}' AS scaler, vec_id, round_even(1 - {linear(seven(*gone))}, 6) AS risk_score FROM vectors, weights" for name, gone in {"full": (), "no_income": (2,), "no_age_income": (1, 2), "subset": (), "subset_no_income": (2,), "untold": ()}.items()),
        "score_months": "SELECT doc_id, statement_month, round_even(round_even(1 - p, 6), 4) AS risk_score, round_even(p, 4) AS saving_probability FROM (SELECT doc_id, statement_month, " + linear("x", 0.1) + f" AS p FROM (SELECT doc_id, statement_month, [{', '.join(month_value(c) for c in MONTH_COLUMNS)}] AS x FROM final_rows), month_weights)",
        "field_renames": "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 <> 0 THEN (c_custkey % 50)::DOUBLE END, CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey % 100)::DOUBLE END) AS \"Expense_Distribution_Food\", CASE WHEN c_custkey % 7 <> 0 THEN trunc(c_acctbal)::DOUBLE END AS \"Expense_Distribution_Housing\", (c_custkey % 9)::DOUBLE AS \"Save_Money_Yes\" FROM customer",
        "traceability": "SELECT DISTINCT source AS doc_id, true AS processed FROM documents",
        "registry_exact": f"SELECT query, coalesce(c.contained_name, a.name, nullif(short, ''), display) AS brand FROM exact_firms e LEFT JOIN (SELECT norm AS both_names, contained_name FROM ({contained('firm_texts')})) c ON e.both_names = c.both_names LEFT JOIN aliases a ON e.dataset = a.alias",
        "assemble_row": f"SELECT c_custkey, {', '.join(assembled)} FROM whole JOIN answered ON doc_id = c_custkey",
        "profile_encode": "SELECT c_custkey, " + ", ".join(f'{v} AS "{n}"' for n, v in profile_values().items()) + ", true AS complete FROM answered",
        "factor_topk": f"SELECT m.vec_id, coalesce(a.t, '') AS top_factors, coalesce(b.t, '') AS risk_factors, coalesce(c.t, '') AS healthy_factors FROM model m LEFT JOIN {top('true', 'abs(c) DESC')} a ON m.vec_id = a.vec_id LEFT JOIN {top('c > 0', 'c DESC')} b ON m.vec_id = b.vec_id LEFT JOIN {top('c < 0', 'c')} c ON m.vec_id = c.vec_id",
        "alerts": f"SELECT vec_id, array_to_string(list_filter([{', '.join(f'CASE WHEN {c} THEN {s(m)} END' for c, m in rules)}], lambda x: x IS NOT NULL), ',') AS alerts FROM scored",
        "monthly_average": "SELECT a.label, risk_score, saving_probability, months, factors FROM (SELECT label, round_even(avg(risk_score), 6) AS risk_score, round_even(avg(saving_probability), 6) AS saving_probability, count(*) AS months FROM scored GROUP BY label) a JOIN (SELECT label, string_agg(f, ',' ORDER BY abs(m) DESC, f) AS factors FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY abs(m) DESC, f) AS k FROM (SELECT label, f, round_even(avg(round_even(c, 6)), 6) AS m FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(c) DESC, i) AS r FROM contributions) WHERE r <= 5 GROUP BY ALL)) WHERE k <= 5 GROUP BY label) b ON a.label = b.label",
        "month_backfill_update": "SELECT statement_month, coalesce(r, -0.25) AS \"Risk_Score\", CASE WHEN coalesce(r, -0.25) <= -0.10 THEN 'Healthy' WHEN coalesce(r, -0.25) <= 0.20 THEN 'Moderate' ELSE 'Risky' END AS \"Behavior_Risk_Level\", \"Save_Money_Yes\" FROM (" + features("month_totals", "statement_month") + ") LEFT JOIN (VALUES ('2024-01', 0.15::DOUBLE), ('2024-02', 0.5)) v(month, r) ON statement_month = month",
        "report_cap": "SELECT seq, transaction_id, amount, greatest(0, (SELECT count(*) FROM ledger) - 500) AS transactions_omitted_from_report FROM ledger ORDER BY seq LIMIT 500",
        "semi_anti_union_sets": "SELECT 'semi' AS part, c_custkey FROM customer WHERE c_custkey IN (SELECT c FROM big) UNION ALL SELECT 'anti', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT c FROM big) UNION ALL (SELECT 'intersect', c FROM big INTERSECT SELECT 'intersect', c FROM urgent) UNION ALL SELECT DISTINCT 'except', c FROM (SELECT c FROM big EXCEPT ALL SELECT c FROM urgent) UNION ALL (SELECT 'union', c FROM big UNION SELECT 'union', c FROM urgent)",
    }
    mirrored = lambda rows: f"SELECT *, min(seq) OVER (PARTITION BY ref, round_even(amount, 2), txn_type) AS place, row_number() OVER (PARTITION BY ref, round_even(amount, 2), txn_type ORDER BY (fd = 'debit' AND direction = 'credit') DESC, seq) AS k FROM (SELECT *, first_value(direction) OVER (PARTITION BY ref, round_even(amount, 2), txn_type ORDER BY seq) AS fd FROM (SELECT *, CASE WHEN txn_type IN ('internal_transfer', 'external_transfer') THEN {ref} END AS ref FROM {rows}))"
    more = {
        "kpi_block": {"kpi_totals": totals(keys="doc_id", group="GROUP BY doc_id", more=", count(*) FILTER (WHERE txn_type IN ('external_transfer', 'internal_transfer') AND state IN ('unknown', 'candidate')) AS unknown_transfer_count")},
        "dedup_mirror": {"tied": mirrored("both_sides")},
        "removed_ids": {"once": f"SELECT *, row_number() OVER (PARTITION BY booking_date, round_even(amount, 2), direction, source_section, {desc} ORDER BY seq) AS r FROM both_sides", "tied": mirrored("(SELECT * FROM once WHERE r = 1)")},
        "header_footer_removal": {"edged": f"SELECT *, {KEY} AS key, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY line_no) AS up, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY line_no DESC) AS down FROM page_lines"},
        "semi_anti_union_sets": {"big": "SELECT o_custkey AS c FROM orders WHERE o_totalprice > 200000", "urgent": "SELECT o_custkey AS c FROM orders WHERE o_orderpriority = '1-URGENT'"},
    }
    more["parse_incremental"] = {
        "raw_lines": CTE["statement_lines"],
        "pages": "SELECT doc_id, 1 AS page_no, string_agg(line, chr(10) ORDER BY line_no) AS text FROM raw_lines GROUP BY doc_id",
        "edged": more["header_footer_removal"]["edged"],
        "statement_lines": f"SELECT doc_id, line_no, line FROM ({out['header_footer_removal']})",
    }
    out["parse_incremental"] = out["statement_parse"]
    more["score_months"] = {"final_rows": out["final_row_month"]}
    more["assemble_row"] = {"whole_totals": totals(keys="doc_id", group="GROUP BY doc_id"), "whole": features("whole_totals", "doc_id")}
    done = {name: q(sql, **more.get(name, {})) for name, sql in out.items()}
    done["memory_backfill"] = q(f"SELECT seq, state, evidence_type, match_source, category_area, confidence, fuzzy_match_term, fuzzy_match_score FROM transferred WHERE {tr}", **memory)
    forward = {**memory, "transferred": transferred("late_rows", True, back=False)[2]}
    done["memory_stream"] = q(f"SELECT seq, state, evidence_type, match_source, category_area, confidence, fuzzy_match_term, fuzzy_match_score FROM transferred WHERE {tr}", **forward)
    timed = "SELECT own.*, ts FROM own JOIN events ON seq = event_id WHERE txn_type IN ('external_transfer', 'salary_income')"
    done["memory_asof"] = q(f"SELECT r.seq, r.entity_key, v.seq AS from_seq, v.o_area AS category FROM ({timed}) r ASOF LEFT JOIN (SELECT * FROM ({timed}) WHERE o_state = 'confirmed') v ON r.entity_key = v.entity_key AND r.ts > v.ts", **memory)
    done["memory_upsert"] = q(
        f"SELECT coalesce(m_key, entity_key) AS entity_key, coalesce(f_name, m_name) AS canonical_name, coalesce(f_area, m_category) AS category, coalesce(f_confidence, m_confidence) AS confidence, 'confirmed' AS status, coalesce(m_first, month) AS first_seen, coalesce(month, m_last) AS last_seen, (coalesce(m_months, 0) + CASE WHEN month IS NOT NULL AND m_last IS DISTINCT FROM month THEN 1 ELSE 0 END)::INT AS months_seen, coalesce(f_evidence, m_evidence) AS evidence_type FROM (SELECT *, {MONTH.replace('booking_date', 'f_date')} AS month FROM firsts) FULL OUTER JOIN (SELECT * FROM {table_of(MEMORY, *MEMORY_NAMES)}) ON entity_key = m_key",
        **memory,
    )
    done["dense_scores"] = dense()
    done["memory_state"] = done["memory_upsert"]
    done["mirror_stream"] = done["dedup_mirror"]
    return done
