"""Word lists, lookup tables, patterns and limits that results must agree on."""

from __future__ import annotations

# Enumerations.
SECTIONS = ["booked_transactions", "blocked_amounts"]
CHANNELS = ["POS", "EPOS", "ATM", "TRANSFER", "FEE", "BLOCKED", "OTHER"]
CATEGORIES = ["Food", "Housing", "Transport", "Entertainment", "Health", "Personal_Care", "Child_Education", "Other", "Unknown"]

# Transaction types: hints are substrings of the upper-cased description.
ATM_HINTS = ["ATM", "RETRAGERE DE NUMERAR", "RETRAGERE NUMERAR"]
FEE_HINTS = ["TAXA", "COMISION", "TAXA SERVICIU SMS", "COMISION PLATA INSTANT"]
INTERNAL_HINTS = ["TRANSFER BT PAY", "P2P BTPAY", "P2P BT PAY", "TRANSFER INTERN"]
EXTERNAL_HINTS = ["PLATA INSTANT", "TRANSFER CATRE", "TRANSFER EXTERN", "IBAN", "BENEFICIAR"]
POS_HINTS = ["EPOS", "POS"]
SALARY_HINTS = ["SALARIU", "SALARY", "DREPTURI SALARIALE", "PAYROLL"]
BROAD_HINTS = ["CATRE", "TO"]
FEE_FRAGMENT = r"\bCOMISION\s+TRANZACTIE\b"

# Dictionary of transfer categories, in file order.
TRANSFER_TERMS = {
    "housing": {
        "exact_terms": [
            "chirie",
            "rent",
            "lease",
            "landlord",
            "intretinere",
            "maintenance",
            "asociatia proprietarilor",
            "asociatie proprietari",
            "owners association",
            "property management",
            "building maintenance",
            "apartment maintenance",
            "apartament",
            "apartment",
        ],
        "transfer_terms": ["chirie", "rent", "lease", "intretinere", "maintenance", "apartament", "apartment", "asociatie", "association", "landlord"],
        "recipient_terms": ["asociatia proprietarilor", "asociatie proprietari", "owners association", "property management", "landlord"],
        "merchant_terms": ["ppc energie", "enel", "engie", "electrica", "apa nova", "digi", "orange", "vodafone", "telekom", "yoxo"],
        "negative_terms": ["refund", "return", "reversal", "chargeback"],
        "fuzzy": 92.0,
    },
    "utilities": {
        "exact_terms": ["energie", "electricity", "electric", "gas", "water", "internet", "utilities", "utility bill", "factura", "invoice"],
        "merchant_terms": ["ppc energie", "enel", "engie", "electrica", "apa nova", "digi", "orange", "vodafone", "telekom", "yoxo"],
        "negative_terms": ["refund", "return"],
        "fuzzy": 93.0,
    },
    "internal_transfer": {
        "exact_terms": ["transfer bt pay", "transfer intern", "p2p btpay", "transfer din card", "catre", "own transfer", "internal transfer"],
        "negative_terms": ["chirie", "rent", "intretinere", "maintenance"],
        "fuzzy": None,
    },
    "salary_income": {
        "exact_terms": ["salariu", "salary", "payroll", "wage", "incasare op"],
        "negative_terms": [],
        "fuzzy": 95.0,
    },
}
#: Tokens that normalised descriptions and terms lose.
#: Fixed value: references inside transfer descriptions.
TRANSFER_REFERENCE = r"\b(?:ref|rrn|tid)\s*:?\s*[a-z0-9-]+\b"
NOISE_TOKENS = ["REF", "RRN", "TID", "POS", "EPOS", "PLATA", "TRANSFER", "INSTANT", "CANAL", "ELECTRONIC"]

# Merchant extraction.
MERCHANT_TYPES = ["card_purchase", "subscription", "utility_payment"]
URL = r"https?://\S+"
REFERENCES = [r"\bTID\s*[:=]?\s*[A-Z0-9-]+\b", r"\bRRN\s*[:=]?\s*[A-Z0-9-]+\b", r"\bREF\s*[:=]?\s*[A-Z0-9-]+\b"]
FEE_PHRASES = [r"\bCOMISION\s+TRANZACTIE\b", r"\bVALOARE\s+TRANZACTIE\b"]
AMOUNT_WITH_CURRENCY = r"[+-]?\d+(?:[.,]\d{3})*[.,]\d{2}\s*(?:RON|EUR|USD|GBP)?"
LEADING_BOILERPLATE = r"^(?:PLATA\s+LA\s+POS(?:\s+NON-BT)?(?:\s+CU\s+CARD)?\s+MASTERCARD\s*|PLATA\s+LA\s+POS\s*)"
TRAILING_NOISE = r"\b(?:SOLD\s+FINAL\s+ZI|SOLD\s+FINAL\s+CONT|SOLICITANT\s*:?[\sA-Z0-9-]*TIPARIT\s*:?.*)$"
PAYMENT_GATEWAY = r"PAYU\*[A-Z0-9./-]+"
BRAND_WITH_SHOP = r"MEGAIMAGE(?:\s+\d{2,6}(?:\s+[A-Z]+)*)?"
FIRST_BRANDS = [(r"PRANZOBYESS(?:@FBP\s*C\d+)?", "PRANZOBYESS"), (r"PPC\s+ENERGIE\s+SA", "PPC ENERGIE SA")]
BRANDS = [
    (r"\bCARREFOUR\b", "CARREFOUR"),
    (r"\bAUCHAN(?:\s+ROMANIA\s+SA)?\b", "AUCHAN ROMANIA SA"),
    (r"\bAUCH\b", "AUCHAN ROMANIA SA"),
    (r"\bMETROREX\b", "METROREX VALIDATOARE"),
    (r"\bTACO\s+BELL\b", "TACO BELL"),
    (r"\bMOVIEPLEX\b", "MOVIEPLEX"),
    (r"\bDM\s+DROGERIE\s+MARKT\b", "DM DROGERIE MARKT"),
    (r"\bFROO\b", "FROO"),
    (r"\bDIGI\s+RO\b", "DIGI"),
    (r"\bJKC\s+RESTAURANTS\b", "JKC RESTAURANTS"),
    (r"\bFARMACIA\b", "FARMACIA"),
]
TECHNICAL_TOKENS = ["POS", "EPOS", "UNKNOWN", "TRANZACTIE", "TRANZACTIA", "COMISION", "VALOARE", "CARD", "BT"]
LOCATION_TOKENS = ["RO", "ROMANIA", "BUCURESTI", "BUCURESTIULUI", "CLUJ", "TIMISOARA", "IASI", "MOGHIOR"]

# Merchant aliases: canonical name to its spellings.
ALIASES = {
    "Auchan": ["AUCHAN", "AUCHAN ROMANIA SA"],
    "Carrefour": ["CARREFOUR", "CARREFOUR MK", "CARREFOUR MARKET"],
    "Digi": ["DIGI", "DIGI RO"],
    "DM Drogerie Markt": ["DM DROGERIE MARKT", "DM DROGERIE MARKT SRL"],
    "Farmacia": ["FARMACIA"],
    "Froo": ["FROO"],
    "JKC Restaurants": ["JKC RESTAURANTS", "JKC RESTAURANTS ROMANIA"],
    "Mega Image": ["MEGA IMAGE SRL", "MEGAIMAGE", "MEGAIMAGE 0156 MOGHIOR", "MEGAIMAGE 0290"],
    "Metrorex": ["METROREX VALIDATOARE"],
    "Movieplex": ["MOVIEPLEX", "MOVIEPLEX CASA BILET"],
    "Orange Yoxo": ["ORANGE YOXO", "WWW.ORANGE.RO/YOXO"],
    "Altex": ["PAYU*ALTEX.RO"],
    "eMAG": ["PAYU*EMAG", "PAYU*EMAG.RO", "PAYU*EMAG.RO/MARKET"],
    "PPC Energie": ["PPC ENERGIE SA"],
    "Pranzo by ESS": ["PRANZOBYESS", "PRANZOBYESS@FBP C1", "PRANZOBYESS@FBP C2", "PRANZOBYESS@FBP C3"],
    "Taco Bell": ["TACO BELL", "TACO BELL KIOSK"],
}
FUZZY_ALIAS_LEAST = 0.88
REGISTRY_LEAST = 60.0
REGISTRY_CANDIDATES = 150

# Registry names.
LEGAL_SUFFIXES = ["SRL", "SA", "SRL-D", "PFA", "PF", "IF", "II", "SNC", "SCS", "SCA"]
STOPWORDS = [
    "by",
    "ess",
    "romania",
    "roumanie",
    "import",
    "export",
    "plata",
    "pos",
    "epos",
    "non",
    "bt",
    "card",
    "mastercard",
    "ron",
    "rrn",
    "tid",
    "ref",
    "valoare",
    "tranzactie",
    "comision",
    "sold",
    "final",
    "zi",
    "transfer",
    "intern",
    "canal",
    "electronic",
    "p2p",
    "ro",
    "rom",
    "bucuresti",
    "unknown",
    "merchant",
    "company",
    "concept",
    "consulting",
    "services",
    "service",
    "invest",
    "international",
    "group",
    "holding",
]
BRAND_PREFIXES = ["AUCH", "CARR", "MEGA", "PRAN", "EMAG", "ALTE", "METR", "TACO", "MOVI", "FROO", "DIGI", "PPC", "ORAN", "YOXO", "JKC", "FARM"]

# Spending areas.
MERCHANT_CATEGORIES = {
    "eMAG": "Other",
    "Altex": "Other",
    "Pranzo by ESS": "Food",
    "Mega Image": "Food",
    "Carrefour": "Food",
    "Auchan": "Food",
    "Froo": "Food",
    "Taco Bell": "Food",
    "JKC Restaurants": "Food",
    "PPC Energie": "Housing",
    "Orange Yoxo": "Housing",
    "Digi": "Housing",
    "Spotify": "Entertainment",
    "Movieplex": "Entertainment",
    "Metrorex": "Transport",
    "DM Drogerie Markt": "Personal_Care",
    "Farmacia": "Health",
}
CATEGORY_PATTERNS = [(r"^FARMACIA\b", "Health"), (r"^ORANGE\b", "Housing")]
CATEGORY_BY_TYPE = {"card_purchase": "Other", "subscription": "Entertainment", "utility_payment": "Housing"}
ELECTRONICS_MERCHANTS = ["eMAG", "Altex"]
QUICK_FOOD_MERCHANTS = ["Pranzo by ESS", "Taco Bell", "Froo", "JKC Restaurants"]
IMPULSE_MOST = 300.0
ESSENTIAL = ["Food", "Housing", "Transport", "Health"]
EXCLUDED_TYPES = ["internal_transfer", "cash_withdrawal", "blocked_amount", "bank_fee"]
IMPULSE_EXCLUDED_TYPES = ["internal_transfer", "external_transfer", "bank_fee", "blocked_amount", "cash_withdrawal"]
IMPULSE_EXCLUDED_CATEGORIES = ["Housing", "Transport", "Health", "Child_Education"]
IMPULSE_BUCKETS = ["clothing_personal_care", "electronics_gadgets", "entertainment", "food", "other"]

# Industry codes.
CODE_CATEGORY = {"3250": "Health", "4646": "Health", "4773": "Health", "4775": "Personal_Care", "4932": "Transport", "4939": "Transport", "5221": "Transport", "5510": "Entertainment"}
PREFIX_CATEGORY = {
    "10": "Food",
    "11": "Food",
    "47": "Food",
    "56": "Food",
    "35": "Housing",
    "36": "Housing",
    "61": "Housing",
    "68": "Housing",
    "45": "Transport",
    "49": "Transport",
    "50": "Transport",
    "52": "Transport",
    "59": "Entertainment",
    "90": "Entertainment",
    "93": "Entertainment",
    "21": "Health",
    "86": "Health",
    "32": "Health",
    "96": "Personal_Care",
    "85": "Child_Education",
}
ELECTRONICS, CLOTHING = "Electronics or gadgets", "Clothing or personal care products"
CODE_IMPULSE = {
    "4741": ELECTRONICS,
    "4742": ELECTRONICS,
    "4743": ELECTRONICS,
    "4651": ELECTRONICS,
    "4652": ELECTRONICS,
    "9521": ELECTRONICS,
    "9522": ELECTRONICS,
    "4771": CLOTHING,
    "4772": CLOTHING,
    "4775": CLOTHING,
    "9602": CLOTHING,
    "9604": CLOTHING,
    "5914": "Entertainment",
    "9321": "Entertainment",
}
PREFIX_IMPULSE = {"47": "Food", "56": "Food", "59": "Entertainment", "90": "Entertainment", "93": "Entertainment"}
CODE_LIFETIME = {
    "4511": "Cars",
    "4519": "Cars",
    "4520": "Cars",
    "4531": "Cars",
    "4532": "Cars",
    "4741": "Tech",
    "4742": "Tech",
    "4743": "Tech",
    "4651": "Tech",
    "4652": "Tech",
    "4754": "Appliances",
    "9522": "Appliances",
    "4771": "Clothing",
    "4772": "Clothing",
}
PRIMARY_ORDER = ["Food", "Housing", "Transport", "Health", "Personal_Care", "Child_Education", "Entertainment", "Other"]
INDUSTRY_OVERRIDES = {"5610": "Restaurante", "6201": "Activitati software", "4711": "Comert cu amanuntul"}
UNKNOWN_INDUSTRY = "Necunoscut"

# Statement lines.
LINE_NOISE = ["BANCA TRANSILVANIA", "EXTRAS DE CONT", "PAGINA", "IBAN", "SWIFT"]
BOOKED_HEADERS = ["TRANZACTII EFECTUATE", "TRANZACTII CONTABILIZATE", "OPERATIUNI EFECTUATE"]
BLOCKED_HEADERS = ["SUME BLOCATE", "BLOCARE SUME", "OPERATIUNI BLOCATE"]
TABLE_HEADERS = ["DATA DESCRIERE DEBIT CREDIT", "DATA DESCRIERE DEBIT", "DATA DESCRIERE CREDIT"]
DATED_NOISE = ["RULAJ ZI", "SOLD FINAL ZI", "SOLD ANTERIOR", "SOLD FINAL", "EXTRAS CONT", "RULAJ TOTAL CONT"]
ENTRY_STARTS = ["PLATA LA POS", "TRANSFER INTERN", "P2P BTPAY", "RETRAGERE DE NUMERAR", "TAXA SERVICIU", "COMISION ", "PLATA INSTANT"]
BLOCKED_ENTRY = "AFERENTA TRANZACTIEI"
CREDIT_WORDS = ["INCASARE", "ALIMENTARE", "DOBANDA", "REFUND"]
DATE = r"\b(\d{2}/\d{2}/\d{4})\b"
DATE_START = r"^\d{2}/\d{2}/\d{4}\b"
CURRENCY = r"\b(RON|EUR|USD|GBP)\b"
AMOUNT = r"[+-]?\d+(?:[.,]\d{3})*(?:[.,]\d{2})"

# Features.
DISTRIBUTION_LEAST = 5.0
DISTRIBUTION = ["Food", "Housing", "Transport", "Entertainment", "Health", "Personal_Care", "Child_Education", "Other"]
IMPULSE_CATEGORIES = {
    "Clothing or personal care products": "clothing_personal_care",
    "Electronics or gadgets": "electronics_gadgets",
    "Entertainment": "entertainment",
    "Food": "food",
    "Other": "other",
}
QUESTIONS = {
    "Family status": {
        "In a relationship / married with children": "Family_Status_In a relationship/married with children",
        "In a relationship / married without children": "Family_Status_In a relationship/married without children",
        "Single, no children": "Family_Status_Single, no children",
        "Single, with children": "Family_Status_Single, with children",
        "Other": "Family_Status_Another",
    },
    "Gender": {"Female": "Gender_Female", "Male": "Gender_Male", "Prefer not to say": "Gender_Prefer not to say"},
    "Financial attitude": {
        "I am disciplined in saving": "Financial_Attitude_I am disciplined in saving",
        "I try to find a balance": "Financial_Attitude_I try to find a balance",
        "I spend more than I earn": "Financial_Attitude_Spend more than I earn",
    },
    "Budget planning": {
        "I do not plan at all": "Budget_Planning_Don't plan at all",
        "I plan my budget in detail": "Budget_Planning_Plan budget in detail",
        "I plan only essentials": "Budget_Planning_Plan only essentials",
    },
    "Impulse buying reason": {
        "Discounts or promotions": "Impulse_Buying_Reason_Discounts or promotions",
        "Self-reward": "Impulse_Buying_Reason_Self-reward",
        "Social pressure": "Impulse_Buying_Reason_Social pressure",
        "Other": "Impulse_Buying_Reason_Other",
    },
    "Financial investments": {
        "No, but interested": "Financial_Investments_No, but interested",
        "No, not interested": "Financial_Investments_No, not interested",
        "Yes, occasionally": "Financial_Investments_Yes, occasionally",
        "Yes, regularly": "Financial_Investments_Yes, regularly",
    },
    "Credit usage": {
        "Essential needs": "Credit_Usage_Essential_Needs",
        "Major purchases": "Credit_Usage_Major_Purchases",
        "Unexpected expenses": "Credit_Usage_Unexpected_Expenses",
        "Personal needs": "Credit_Usage_Personal_Needs",
        "I never use credit": "Credit_Usage_Never_Used",
    },
    "Savings obstacles": {
        "Insufficient income": "Savings_Obstacle_Insufficient_Income",
        "Other expenses": "Savings_Obstacle_Other_Expenses",
        "Not a priority": "Savings_Obstacle_Not_Priority",
        "Other": "Savings_Obstacle_Other",
    },
}
OPTIONAL_QUESTIONS = ["Savings obstacles"]
MULTI_QUESTIONS = {
    "Savings goals": {
        "Major purchases": "Savings_Goal_Major_Purchases",
        "Retirement": "Savings_Goal_Retirement",
        "Emergency fund": "Savings_Goal_Emergency_Fund",
        "Child education": "Savings_Goal_Child_Education",
        "Vacation": "Savings_Goal_Vacation",
        "Other": "Savings_Goal_Other",
    }
}
OPTIONAL_FEATURES = {"Savings goals": ["Savings_Goal_Emergency_Fund"]}
ORDINAL_QUESTIONS = {
    "Debt level": ("Debt_Level", {"Absent": 0.0, "Low": 1.0, "Manageable": 2.0, "High": 3.0}),
    "Bank account analysis frequency": ("Bank_Account_Analysis_Frequency", {"Daily": 3.0, "Weekly": 2.0, "Monthly": 1.0, "Rarely or never": 0.0}),
}
LIFETIMES = ["Product_Lifetime_Clothing", "Product_Lifetime_Tech", "Product_Lifetime_Appliances", "Product_Lifetime_Cars"]
NUMERIC_FEATURES = ["Age", *LIFETIMES]
NOT_PURCHASED = ["not purchased yet", "not_purchased"]
SCALED_FEATURES = ["Age", "Income_Category", "Essential_Needs_Percentage", *LIFETIMES]
HEALTHY_BELOW, RISKY_FROM = 0.33, 0.67
HIGH_RISK, SAVING_LEAST, TOP_FACTORS = 0.7, 0.5, 5
#: Older names of the model's share columns.
PERCENT_ALIASES = {f"{c.lower()}_total_pct": f"Expense_Distribution_{c}" for c in DISTRIBUTION}

TRANSACTION_COLUMNS = [
    ("transaction_id", "string"),
    ("booking_date", "string"),
    ("amount", "double"),
    ("currency", "string"),
    ("direction", "string"),
    ("raw_description", "string"),
    ("source_section", "string"),
    ("channel", "string"),
    ("txn_type", "string"),
    ("merchant_raw", "string"),
    ("merchant_canonical", "string"),
    ("normalization_source", "string"),
    ("merchant_match_method", "string"),
    ("category_area", "string"),
    ("mapping_method", "string"),
    ("confidence", "double"),
    ("recipient_name", "string"),
    ("recipient_iban", "string"),
    ("entity_key", "string"),
    ("state", "string"),
    ("evidence_type", "string"),
    ("match_source", "string"),
    ("fuzzy_match_term", "string"),
    ("fuzzy_match_score", "double"),
    ("final_spend_category", "string"),
    ("is_essential", "boolean"),
    ("is_nonessential", "boolean"),
    ("is_internal_transfer", "boolean"),
    ("is_salary", "boolean"),
    ("is_housing", "boolean"),
    ("is_utility", "boolean"),
    ("is_impulse_candidate", "boolean"),
    ("impulse_category", "string"),
    ("classification_confidence", "double"),
]


#: The columns of the final monthly row, in order.
FINAL_COLUMNS = [
    "Age",
    "Income_Category",
    "Essential_Needs_Percentage",
    "Product_Lifetime_Clothing",
    "Product_Lifetime_Tech",
    "Product_Lifetime_Appliances",
    "Product_Lifetime_Cars",
    "Impulse_Buying_Frequency",
    "Debt_Level",
    "Bank_Account_Analysis_Frequency",
    "Savings_Goal_Major_Purchases",
    "Savings_Goal_Retirement",
    "Savings_Goal_Emergency_Fund",
    "Savings_Goal_Child_Education",
    "Savings_Goal_Vacation",
    "Savings_Goal_Other",
    "Savings_Obstacle_Other",
    "Savings_Obstacle_Insufficient_Income",
    "Savings_Obstacle_Other_Expenses",
    "Savings_Obstacle_Not_Priority",
    "Expense_Distribution_Food",
    "Expense_Distribution_Housing",
    "Expense_Distribution_Transport",
    "Expense_Distribution_Entertainment",
    "Expense_Distribution_Health",
    "Expense_Distribution_Personal_Care",
    "Expense_Distribution_Child_Education",
    "Expense_Distribution_Other",
    "Credit_Usage_Essential_Needs",
    "Credit_Usage_Major_Purchases",
    "Credit_Usage_Unexpected_Expenses",
    "Credit_Usage_Personal_Needs",
    "Credit_Usage_Never_Used",
    "Family_Status_Another",
    "Family_Status_In a relationship/married with children",
    "Family_Status_In a relationship/married without children",
    "Family_Status_Single, no children",
    "Family_Status_Single, with children",
    "Gender_Female",
    "Gender_Male",
    "Gender_Prefer not to say",
    "Financial_Attitude_I am disciplined in saving",
    "Financial_Attitude_I try to find a balance",
    "Financial_Attitude_Spend more than I earn",
    "Budget_Planning_Don't plan at all",
    "Budget_Planning_Plan budget in detail",
    "Budget_Planning_Plan only essentials",
    "Save_Money_No",
    "Save_Money_Yes",
    "Impulse_Buying_Category_Clothing or personal care products",
    "Impulse_Buying_Category_Electronics or gadgets",
    "Impulse_Buying_Category_Entertainment",
    "Impulse_Buying_Category_Food",
    "Impulse_Buying_Category_Other",
    "Impulse_Buying_Reason_Discounts or promotions",
    "Impulse_Buying_Reason_Other",
    "Impulse_Buying_Reason_Self-reward",
    "Impulse_Buying_Reason_Social pressure",
    "Financial_Investments_No, but interested",
    "Financial_Investments_No, not interested",
    "Financial_Investments_Yes, occasionally",
    "Financial_Investments_Yes, regularly",
    "Risk_Score",
    "Behavior_Risk_Level",
]


def final_columns() -> list[str]:
    """The 64 columns of the final monthly row, in order."""
    return list(FINAL_COLUMNS)


def feature_columns() -> list[str]:
    """The 19 columns of a feature vector, in order."""
    return [
        *(f"Expense_Distribution_{c}" for c in DISTRIBUTION),
        "Unknown_Expense_Percentage",
        "Essential_Needs_Percentage",
        "Discretionary_Spending_Percentage",
        "Save_Money_No",
        "Save_Money_Yes",
        "Impulse_Buying_Frequency",
        *(f"Impulse_Buying_Category_{c}" for c in IMPULSE_CATEGORIES),
    ]


#: Final columns that stay real numbers or text; all others are whole.
REAL_COLUMNS = ["Age", "Income_Category", "Essential_Needs_Percentage", *LIFETIMES, "Risk_Score", "Behavior_Risk_Level"]


def statement_features() -> list[str]:
    """Final columns that statements give; the profile gives the others."""
    known = {*feature_columns(), "Income_Category"}
    return [c for c in final_columns() if c in known]


def internal_hints() -> list[str]:
    return _extended(INTERNAL_HINTS, "internal_transfer")


def salary_hints() -> list[str]:
    return _extended(SALARY_HINTS, "salary_income")


def _extended(hints: list[str], category: str) -> list[str]:
    """Hints and the dictionary's exact terms in capitals, but for the broad ones."""
    terms = [t.strip().upper() for t in TRANSFER_TERMS[category]["exact_terms"]]
    return list(dict.fromkeys([*hints, *(t for t in terms if t and t not in BROAD_HINTS)]))


UTILITY_TERMS = list(dict.fromkeys(TRANSFER_TERMS["housing"]["merchant_terms"] + TRANSFER_TERMS["utilities"]["merchant_terms"]))
