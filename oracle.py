"""The registered queries as SQL over the given tables."""

from __future__ import annotations

from centsible import testbed as tb
from centsible.sources.categories import SEED

YEAR = ("DATE '1998-01-01'", "DATE '1998-12-31'")
YEAR_BEFORE = ("DATE '1997-01-01'", "DATE '1997-12-31'")


def _case(column: str, mapping: dict[str, str], otherwise: str = "NULL") -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {column} {arms} ELSE {otherwise} END"


def _text(value) -> str:
    return "NULL" if value is None else f"'{value}'" if isinstance(value, str) else str(value)


def _currency(number: str) -> str:
    return f"[{', '.join(_text(c) for c in tb.CURRENCIES)}][CAST({number} % 4 + 1 AS INTEGER)]"


def uuid(key: str) -> str:
    return (
        f"regexp_replace(md5({key}), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', "
        r"'\1-\2-\3-\4-\5')"
    )


def ratio(part: str, whole: str) -> str:
    """part / whole in 1/10000, half-up, 0 when whole is 0: exact integer arithmetic."""
    p = f"CAST(CAST({part} AS DECIMAL(19,4)) * 10000 AS HUGEINT)"
    w = f"CAST(CAST({whole} AS DECIMAL(19,4)) * 10000 AS HUGEINT)"
    return (
        f"(CASE WHEN {w} = 0 THEN 0 ELSE sign({part}) * ((abs({p}) * 20000 + {w}) // (2 * {w})) END)"
    )


def percent(part: str, whole: str) -> str:
    return f"CAST({ratio(part, whole)} AS DOUBLE) / 100"


FRAGMENTS = {
    "cat": "SELECT * FROM (VALUES "
    + ", ".join("(" + ", ".join(map(_text, row)) + ")" for row in tb.CATEGORIES)
    + ") AS c(id, code, label, parent_id, mcc_codes, keywords)",
    "mcc_rule": """SELECT mcc, min(id) AS id FROM (
        SELECT id, trim(unnest(string_split(mcc_codes, ','))) AS mcc FROM cat WHERE mcc_codes IS NOT NULL)
        GROUP BY mcc""",
    "kw_rule": """SELECT id, lower(trim(unnest(string_split(keywords, ',')))) AS kw
        FROM cat WHERE keywords IS NOT NULL""",
    "card": f"""SELECT 'CN-' || l_orderkey || '-' || l_linenumber AS record_id,
        'AUTH' || l_suppkey AS auth_code,
        lpad(CAST(o_custkey % 10000 AS VARCHAR), 4, '0') AS pan_last_four,
        p_name AS merchant_name, p_brand AS merchant_city,
        {_case('p_type', tb.PART_TYPE_MCC)} AS mcc,
        CAST(l_extendedprice AS DECIMAL(19,4)) AS amount,
        {_currency('o_custkey')} AS currency,
        o_orderdate AS authorised_at,
        CASE WHEN l_returnflag <> 'A' THEN l_shipdate END AS cleared_at,
        {_case('l_returnflag', tb.CLEARING_STATUS)} AS clearing_status,
        l_extendedprice AS s1, l_partkey AS s2, l_suppkey AS s3, l_shipdate AS s4
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "bank": f"""SELECT 'BF-' || o_orderkey AS transaction_id,
        'ACC-' || lpad(CAST(o_custkey AS VARCHAR), 4, '0') AS account_id,
        c_mktsegment AS merchant_name, CAST(o_totalprice AS DECIMAL(19,4)) AS amount,
        {_currency('c_nationkey')} AS currency, o_orderdate AS transacted_at,
        {_case('o_orderstatus', tb.BANK_STATUS)} AS status,
        o_totalprice AS s1, o_custkey AS s2, 0 AS s3, o_orderdate AS s4
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "payment": f"""SELECT 'evt_' || event_id AS event_id,
        {_case('event_type', tb.PAYMENT_EVENT_TYPE, 'event_type')} AS event_type,
        'pi_' || event_id AS payment_id, 'cus_' || user_id AS customer_id,
        event_type AS merchant_descriptor, CAST(value AS DECIMAL(19,4)) AS amount,
        {_currency('user_id')} AS currency, ts AS created_at,
        value AS s1, user_id AS s2, 0 AS s3, ts AS s4
        FROM events""",
    "card_n": """SELECT record_id AS source_id, 'CARD_NETWORK' AS source_type, pan_last_four AS account_id,
        amount, currency, merchant_name, mcc AS merchant_mcc,
        coalesce(cleared_at, authorised_at) AS transacted_at,
        CASE clearing_status WHEN 'CLEARED' THEN 'SETTLED' WHEN 'REVERSED' THEN 'REVERSED'
            ELSE 'PENDING' END AS status,
        s1, s2, s3, s4, merchant_city, auth_code, NULL AS event_type
        FROM card""",
    "bank_n": """SELECT transaction_id AS source_id, 'BANK_FEED' AS source_type, account_id, amount, currency,
        merchant_name, CAST(NULL AS VARCHAR) AS merchant_mcc, transacted_at, status,
        s1, s2, s3, s4, NULL AS merchant_city, NULL AS auth_code, NULL AS event_type
        FROM bank""",
    "payment_n": """SELECT payment_id AS source_id, 'PAYMENT_PROCESSOR' AS source_type,
        customer_id AS account_id, amount, currency, merchant_descriptor AS merchant_name,
        CAST(NULL AS VARCHAR) AS merchant_mcc, created_at AS transacted_at,
        CASE event_type WHEN 'payment_intent.succeeded' THEN 'SETTLED'
            WHEN 'charge.refunded' THEN 'REVERSED' ELSE 'PENDING' END AS status,
        s1, s2, s3, s4, NULL AS merchant_city, NULL AS auth_code, event_type
        FROM payment QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY s1, s2, s3, s4) = 1""",
    "u": "SELECT * FROM card_n UNION ALL SELECT * FROM bank_n UNION ALL SELECT * FROM payment_n",
    # with the age rules, for payments seen at one moment
    "v": f"""SELECT *, [r FOR r IN [
            CASE WHEN NOT coalesce(amount > 0, false) THEN 'amount_not_positive' END,
            CASE WHEN transacted_at > seen + INTERVAL 5 MINUTE THEN 'in_future' END,
            CASE WHEN source_type = 'PAYMENT_PROCESSOR' AND transacted_at < seen - INTERVAL 7 DAY
                THEN 'too_old' END,
            CASE WHEN amount > 100000 THEN 'amount_too_large' END] IF r IS NOT NULL] AS reasons
        FROM (SELECT *, CASE WHEN source_type = 'PAYMENT_PROCESSOR' THEN TIMESTAMP '{tb.PAYMENTS_AS_OF}'
            ELSE transacted_at + INTERVAL 1 HOUR END AS seen FROM u)""",
    # without an age limit
    "ok": "SELECT * FROM u WHERE amount > 0 AND amount <= 100000",
    "firsts": """SELECT * FROM ok
        QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY s1, s2, s3, s4) = 1""",
    "merchant_kw": """SELECT merchant_name, min(id) AS id
        FROM (SELECT DISTINCT merchant_name FROM u) JOIN kw_rule ON contains(lower(merchant_name), kw)
        GROUP BY merchant_name""",
    "t": f"""SELECT f.*, coalesce(m.id, k.id, 9) AS category_id,
        CASE WHEN coalesce(m.id, k.id) IS NULL THEN 'fallback' ELSE 'rules' END AS category_tier,
        {uuid('source_id')} AS external_id,
        transacted_at + INTERVAL 1 HOUR AS created_at
        FROM firsts f LEFT JOIN mcc_rule m ON f.merchant_mcc = m.mcc
        LEFT JOIN merchant_kw k ON f.merchant_name = k.merchant_name""",
    "d": """SELECT account_id, category_id, CAST(transacted_at AS DATE) AS period_date,
        sum(CASE WHEN status = 'SETTLED' THEN amount ELSE 0 END) AS total_spend,
        sum(CASE WHEN status = 'SETTLED' THEN 1 ELSE 0 END) AS transaction_count,
        sum(CASE WHEN status = 'REVERSED' THEN amount ELSE 0 END) AS total_reversed
        FROM t WHERE status IN ('SETTLED', 'REVERSED') GROUP BY ALL""",
    "r": """SELECT account_id, category_id, 'DAILY' AS period_type, period_date,
            total_spend, transaction_count, total_reversed FROM d
        UNION ALL
        SELECT account_id, category_id, 'WEEKLY', CAST(date_trunc('week', period_date) AS DATE),
            sum(total_spend), sum(transaction_count), sum(total_reversed) FROM d GROUP BY ALL
        UNION ALL
        SELECT account_id, category_id, 'MONTHLY', CAST(date_trunc('month', period_date) AS DATE),
            sum(total_spend), sum(transaction_count), sum(total_reversed) FROM d GROUP BY ALL""",
    # both periods of the comparison, per category and per account and category
    "cmp": f"""SELECT category_id,
        sum(CASE WHEN now THEN total_spend ELSE 0 END) AS cur, sum(CASE WHEN now THEN 0 ELSE total_spend END) AS prev,
        sum(CASE WHEN now THEN transaction_count ELSE 0 END) AS cur_n,
        sum(CASE WHEN now THEN 0 ELSE transaction_count END) AS prev_n, max(now) AS is_current
        FROM (SELECT *, period_date >= {YEAR[0]} AS now FROM d
            WHERE period_date BETWEEN {YEAR_BEFORE[0]} AND {YEAR[1]}) GROUP BY category_id""",
    "cmp_a": f"""SELECT account_id, category_id,
        sum(CASE WHEN now THEN total_spend ELSE 0 END) AS cur, sum(CASE WHEN now THEN 0 ELSE total_spend END) AS prev,
        max(now) AS is_current
        FROM (SELECT *, period_date >= {YEAR[0]} AS now FROM d
            WHERE period_date BETWEEN {YEAR_BEFORE[0]} AND {YEAR[1]}) GROUP BY ALL""",
    "months": "SELECT period_date, sum(total_spend) AS spend FROM r WHERE period_type = 'MONTHLY' GROUP BY ALL",
    "brk": """SELECT code AS category_code, label AS category_label, cur, prev,
        sum(cur) OVER () AS cur_total FROM cmp JOIN cat ON category_id = id WHERE is_current""",
    "brk_a": """SELECT account_id, code AS category_code, label AS category_label, cur, prev,
        sum(cur) OVER (PARTITION BY account_id) AS cur_total
        FROM cmp_a JOIN cat ON category_id = id WHERE is_current""",
    "pcat": f"""SELECT id, {uuid('code')} AS external_id, code, label, path, parent_id, mcc_codes FROM (
        SELECT type_id AS id, lower(p_type) AS code, p_type AS label, lower(p_type) AS path,
            NULL AS parent_id, NULL AS mcc_codes FROM typed GROUP BY ALL
        UNION ALL
        SELECT type_id + CAST(split_part(p_brand, '#', 2) AS BIGINT),
            lower(p_type) || '_' || brand, p_brand, lower(p_type) || '.' || lower(p_type) || '_' || brand,
            type_id, list_sort(list_distinct(list('50' || lpad(CAST(p_size AS VARCHAR), 2, '0'))))
        FROM typed GROUP BY p_type, p_brand, brand, type_id)""",
    # the first valid event of each payment, even event numbers first
    "life": """SELECT * REPLACE ('pi_' || payment AS source_id) FROM (
        SELECT *, CAST(substr(source_id, 4) AS BIGINT) AS number, number // 3 AS payment FROM payment_n
        WHERE amount > 0 AND amount <= 100000)
        QUALIFY row_number() OVER (PARTITION BY payment ORDER BY number % 2, s1, s2, s3, s4) = 1""",
    "sized": "SELECT lower(p_type) AS type, CAST(split_part(p_brand, '#', 2) AS BIGINT) AS brand, CAST(p_size AS BIGINT) AS size, CAST("
    + _case("p_type", {name: str(i) for i, name in enumerate(tb.PART_TYPE_MCC, start=1)})
    + " AS BIGINT) * 1000000 AS type_id FROM part",
    "typed": "SELECT *, lower(replace(p_brand, '#', '_')) AS brand, CAST("
    + _case("p_type", {name: str(i) for i, name in enumerate(tb.PART_TYPE_MCC, start=1)})
    + " AS BIGINT) * 1000 AS type_id FROM part",
}
NEEDS = {
    "mcc_rule": ["cat"],
    "kw_rule": ["cat"],
    "card_n": ["card"],
    "bank_n": ["bank"],
    "payment_n": ["payment"],
    "u": ["card_n", "bank_n", "payment_n"],
    "v": ["u"],
    "ok": ["u"],
    "firsts": ["ok"],
    "merchant_kw": ["u", "kw_rule"],
    "t": ["firsts", "mcc_rule", "merchant_kw"],
    "d": ["t"],
    "life": ["payment_n"],
    "r": ["d"],
    "cmp": ["d"],
    "cmp_a": ["d"],
    "brk": ["cmp", "cat"],
    "months": ["r"],
    "brk_a": ["cmp_a", "cat"],
    "pcat": ["typed"],
}


def sql(select: str, *fragments: str) -> str:
    """A statement with the named fragments, and those they need, as common tables."""
    order: list[str] = []

    def add(name: str) -> None:
        for needed in NEEDS.get(name, []):
            add(needed)
        if name not in order:
            order.append(name)

    for fragment in fragments:
        add(fragment)
    return "WITH " + ", ".join(f"{name} AS ({FRAGMENTS[name]})" for name in order) + " " + select


MONEY = "CAST({0} AS DOUBLE) AS {0}"
CANONICAL = (
    "source_id, source_type, account_id, CAST(amount AS DOUBLE) AS amount, currency, merchant_name, "
    "merchant_mcc, transacted_at, status"
)
ROLLUP = (
    "account_id, category_id, CAST(period_date AS VARCHAR) AS period_date, period_type, "
    "CAST(total_spend AS DOUBLE) AS total_spend, CAST(transaction_count AS BIGINT) AS transaction_count, "
    "CAST(total_reversed AS DOUBLE) AS total_reversed"
)
OUTPUT = (
    "t.external_id, source_id, source_type, account_id, CAST(amount AS DOUBLE) AS amount, currency, "
    "merchant_name, merchant_mcc, transacted_at, status, "
    f"{uuid('cat.code')} AS category_external_id, cat.code AS category_code, cat.label AS category_label, "
    "category_tier, created_at"
)
SUMS = (
    "CAST(sum(total_spend) AS DOUBLE) AS total_spend, CAST(sum(transaction_count) AS BIGINT) AS transaction_count"
)
META = """SELECT count(*) AS total_count, {page} AS page, {size} AS page_size,
    CAST(ceil(count(*) / {size}) AS BIGINT) AS total_pages, {page} + 1 < ceil(count(*) / {size}) AS has_more"""


def _anomalies(frame: str, report: str, columns: str) -> str:
    delta = percent("cur - prev", "prev")
    one_decimal = f"CAST((abs({ratio('cur - prev', 'prev')}) + 5) // 10 AS BIGINT)"
    return f"""SELECT {columns} category_code, CASE WHEN z > 0 THEN 'SPIKE' ELSE 'DROP' END AS reason,
        round(z, 2) AS z_score,
        category_label || ' spend ' || (tenths // 10) || '.' || (tenths % 10) || '% '
            || CASE WHEN z > 0 THEN 'above' ELSE 'below' END || ' compared to previous period' AS description
        FROM (SELECT *, (delta - avg(delta) OVER w) / nullif(stddev_pop(delta) OVER w, 0) AS z,
                count(*) OVER w AS n, CAST(sum(whole) OVER w AS HUGEINT) AS s,
                CAST(sum(whole * whole) OVER w AS HUGEINT) AS q
            FROM (SELECT *, {delta} AS delta, {one_decimal} AS tenths,
                CAST({ratio('cur - prev', 'prev')} AS HUGEINT) AS whole FROM {frame})
            WINDOW w AS (PARTITION BY {report}))
        WHERE n >= 3 AND (n * whole - s) * (n * whole - s) > 4 * (n * q - s * s)"""


def _breakdown(frame: str, columns: str = "") -> str:
    return f"""SELECT {columns} category_code, category_label, CAST(cur AS DOUBLE) AS current_spend,
        CAST(prev AS DOUBLE) AS previous_spend, {percent('cur - prev', 'prev')} AS delta_pct,
        {percent('cur', 'cur_total')} AS share_of_total_current FROM {frame}"""


COUNTS = """SELECT source_type, outcome, CAST(sum(n) AS BIGINT) AS records FROM (
        SELECT source_type, 'FAILED' AS outcome, CASE WHEN len(reasons) > 0 THEN 1 ELSE 0 END AS n FROM v
        UNION ALL SELECT source_type, 'ACCEPTED', CASE WHEN place = 1 THEN 1 ELSE 0 END FROM numbered
        UNION ALL SELECT source_type, 'DUPLICATE', CASE WHEN place > 1 THEN 1 ELSE 0 END FROM numbered)
    GROUP BY ALL"""
FRAGMENTS["numbered"] = """SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY s1, s2, s3, s4) AS place
    FROM v WHERE len(reasons) = 0"""
NEEDS["numbered"] = ["v"]
FRAGMENTS["seed"] = (
    "SELECT * FROM (VALUES "
    + ", ".join("(" + ", ".join(map(_text, row)) + ")" for row in SEED)
    + ") AS c(id, code, label, parent_id, mcc_codes, keywords)"
)
FRAGMENTS["seed_mcc"] = FRAGMENTS["mcc_rule"].replace("FROM cat", "FROM seed")
FRAGMENTS["seed_kw"] = FRAGMENTS["kw_rule"].replace("FROM cat", "FROM seed")
NEEDS["seed_mcc"] = NEEDS["seed_kw"] = ["seed"]
# one field broken, by the last digit of the id, and the rules in the order of their report
FRAGMENTS["bad"] = f"""SELECT CASE WHEN d = '6' THEN 'UNHEARD_OF' ELSE source_type END AS source_type,
    CASE WHEN source_type = 'PAYMENT_PROCESSOR' AND d <> '6' THEN TIMESTAMP '{tb.PAYMENTS_AS_OF}'
        ELSE transacted_at + INTERVAL 1 HOUR END AS seen, source_type AS true_type, d, merchant_name,
    CASE WHEN d = '4' THEN NULL ELSE transacted_at END AS transacted_at,
    CASE WHEN d = '8' THEN -amount ELSE amount END AS amount, merchant_mcc
    FROM (SELECT *, right(source_id, 1) AS d FROM u)"""
NEEDS["bad"] = ["u"]
FRAGMENTS["judged_bad"] = """SELECT *, [r FOR r IN [
        CASE WHEN d = '0' THEN 'source_id_blank' END,
        CASE WHEN d = '6' THEN 'source_type_unknown' END,
        CASE WHEN d = '1' THEN 'account_id_blank' END,
        CASE WHEN NOT coalesce(amount > 0, false) THEN 'amount_not_positive' END,
        CASE WHEN d = '2' THEN 'currency_missing' END,
        CASE WHEN d = '3' THEN 'merchant_name_blank' END,
        CASE WHEN d = '4' THEN 'transacted_at_missing' END,
        CASE WHEN d = '5' THEN 'status_unknown' END,
        CASE WHEN d = '7' AND source_type = 'CARD_NETWORK' THEN 'card_mcc_blank' END,
        CASE WHEN d = '1' AND source_type = 'PAYMENT_PROCESSOR' THEN 'payment_account_blank' END,
        CASE WHEN transacted_at > seen + INTERVAL 5 MINUTE THEN 'in_future' END,
        CASE WHEN transacted_at < seen - INTERVAL 7 DAY THEN 'too_old' END,
        CASE WHEN amount > 100000 THEN 'amount_too_large' END] IF r IS NOT NULL] AS reasons FROM bad"""
NEEDS["judged_bad"] = ["bad"]


def oracle_sql() -> dict[str, str]:
    ordered_page = "ORDER BY {0} LIMIT {1} OFFSET {2}"
    return {
        # sources
        "normalise_card": sql(f"SELECT {CANONICAL} FROM card_n", "card_n"),
        "normalise_bank": sql(f"SELECT {CANONICAL} FROM bank_n", "bank_n"),
        "normalise_payment": sql(f"SELECT {CANONICAL} FROM payment_n", "payment_n"),
        "unified_transactions": sql(f"SELECT {CANONICAL} FROM u", "u"),
        "payload_field_query": sql(
            "SELECT source_id, source_type, merchant_city AS city, auth_code, event_type FROM firsts", "firsts"
        ),
        "stored_payload_query": sql(
            "SELECT source_id, source_type, merchant_city AS city, auth_code, event_type FROM firsts", "firsts"
        ),
        # validation and dedup
        "validation_rejects": sql(
            """SELECT source_id, source_type, CAST(amount AS DOUBLE) AS amount, transacted_at,
            reasons[1] AS reject_reason, array_to_string(reasons, ',') AS reject_reasons
            FROM v WHERE len(reasons) > 0""",
            "v",
        ),
        "large_reversals": sql(
            """SELECT source_id, CAST(amount AS DOUBLE) AS amount, len(reasons) > 0 AS is_rejected
            FROM v WHERE status = 'REVERSED' AND amount > 50000""",
            "v",
        ),
        "ingest_outcomes": sql(
            """SELECT source_id, CAST(amount AS DOUBLE) AS amount, 'FAILED' AS outcome FROM v WHERE len(reasons) > 0
            UNION ALL SELECT source_id, CAST(amount AS DOUBLE),
            CASE WHEN place = 1 THEN 'ACCEPTED' ELSE 'DUPLICATE' END FROM numbered""",
            "v",
            "numbered",
        ),
        "ingest_report": sql(COUNTS, "v", "numbered"),
        "processing_counters": sql(
            """SELECT source_type, result, CAST(sum(n) AS BIGINT) AS records FROM (
            SELECT source_type, 'failure' AS result, CASE WHEN len(reasons) > 0 THEN 1 ELSE 0 END AS n FROM v
            UNION ALL SELECT source_type, 'success', CASE WHEN len(reasons) > 0 THEN 0 ELSE 1 END FROM v) GROUP BY ALL""",
            "v",
        ),
        "validation_all_rules": sql(
            """SELECT source_type, reason, count(*) AS records
            FROM (SELECT source_type, unnest(reasons) AS reason FROM judged_bad) GROUP BY ALL""",
            "judged_bad",
        ),
        "registered_source_ingest": sql(
            """SELECT source_id, 'LEDGER' AS source_type, account_id, CAST(amount AS DOUBLE) AS amount, currency,
            merchant_name, merchant_mcc, transacted_at, status FROM bank_n WHERE amount >= 1000 AND amount <= 100000
            QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY s1, s2, s3, s4) = 1""",
            "bank_n",
        ),
        "topic_round_trip": sql(f"SELECT {CANONICAL} FROM firsts", "firsts"),
        "topic_bad_field": sql(
            """SELECT source_id, 'amount_not_positive' AS reject_reason, true AS keeps_text
            FROM firsts WHERE ends_with(source_id, '7')""",
            "firsts",
        ),
        "topic_outcomes": sql(
            f"""SELECT {CANONICAL.replace("CAST(amount", "CAST(CASE WHEN NOT ends_with(source_id, '7') THEN amount END")},
            CASE WHEN ends_with(source_id, '7') THEN 'amount_not_positive' END AS reject_reason,
            ends_with(source_id, '7') AS keeps_text FROM firsts""",
            "firsts",
        ),
        "categorise_seed": sql(
            """SELECT m.merchant_name, m.merchant_mcc, coalesce(r.id, min(k.id), 19) AS category_id,
            CASE WHEN coalesce(r.id, min(k.id)) IS NULL THEN 'fallback' ELSE 'rules' END AS category_tier
            FROM (SELECT DISTINCT merchant_name, merchant_mcc FROM u) m
            LEFT JOIN seed_mcc r ON m.merchant_mcc = r.mcc
            LEFT JOIN seed_kw k ON contains(lower(m.merchant_name), kw)
            GROUP BY m.merchant_name, m.merchant_mcc, r.id""",
            "u",
            "seed_mcc",
            "seed_kw",
        ),
        "category_by_code": sql("SELECT id, code, label, path, parent_id FROM pcat WHERE code = 'promo_brand_12'", "pcat"),
        "category_paths": sql(
            """SELECT id, code, path, depth FROM (
            SELECT type_id AS id, type AS code, type AS path, 1 AS depth FROM sized
            UNION SELECT type_id + brand * 10000, 'b' || brand, type || '.b' || brand, 2 FROM sized
            UNION SELECT type_id + brand * 10000 + (size // 10 + 1) * 100, 't' || (size // 10),
                type || '.b' || brand || '.t' || (size // 10), 3 FROM sized
            UNION SELECT type_id + brand * 10000 + (size // 10 + 1) * 100 + size % 10 + 1, 's' || size,
                type || '.b' || brand || '.t' || (size // 10) || '.s' || size, 4 FROM sized)""",
            "sized",
        ),
        "dedup_first_wins": sql(f"SELECT {CANONICAL} FROM firsts", "firsts"),
        "source_repeats": sql(
            """SELECT record_id, pan_last_four, merchant_name, CAST(amount AS DOUBLE) AS amount FROM card
            QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY s1, s2, s3, s4) = 1""",
            "card",
        ),
        "drop_stored": sql(
            f"""SELECT {CANONICAL} FROM firsts WHERE source_id NOT IN
            (SELECT source_id FROM ok WHERE amount < 50000)""",
            "firsts",
        ),
        "dead_letter_report": sql(
            """SELECT source_type, reason, count(*) AS records
            FROM (SELECT source_type, unnest(reasons) AS reason FROM v) GROUP BY ALL""",
            "v",
        ),
        "dead_letter_context": sql(
            """SELECT source_id, source_type, account_id, CAST(amount AS DOUBLE) AS amount, currency, status,
            'validation' AS stage, CAST(0 AS BIGINT) AS batch_id, array_to_string(reasons, ',') AS failure_cause
            FROM v WHERE len(reasons) > 0""",
            "v",
        ),
        # categories
        "categorise_mcc": sql(
            """SELECT source_id, merchant_mcc, m.id AS mcc_category_id
            FROM firsts LEFT JOIN mcc_rule m ON merchant_mcc = m.mcc""",
            "firsts",
            "mcc_rule",
        ),
        "categorise_keyword": sql(
            """SELECT source_id, f.merchant_name, k.id AS keyword_category_id
            FROM firsts f LEFT JOIN merchant_kw k ON f.merchant_name = k.merchant_name""",
            "firsts",
            "merchant_kw",
        ),
        "categorise_tiers": sql(
            "SELECT source_id, category_id, category_tier FROM t", "t"
        ),
        "python_classifier": sql(
            """SELECT source_id,
            CASE WHEN category_tier = 'fallback' AND contains(merchant_name, 'widget') AND amount <= 50000
                THEN 6 ELSE category_id END AS category_id,
            CASE WHEN category_tier = 'fallback' AND contains(merchant_name, 'widget') AND amount <= 50000
                THEN 'ml' ELSE category_tier END AS category_tier FROM t""",
            "t",
        ),
        "accepted_transactions": sql(
            f"""SELECT {CANONICAL}, external_id, category_id, category_tier, created_at,
            CAST(CAST(transacted_at AS DATE) AS VARCHAR) AS transacted_date FROM t""",
            "t",
        ),
        "accepted_events": sql(
            "SELECT source_id AS key, source_id, account_id, CAST(amount AS DOUBLE) AS amount, status FROM t", "t"
        ),
        "categorised_events": sql(
            """SELECT source_id AS key, source_id, account_id, CAST(amount AS DOUBLE) AS amount, code AS category_code,
            category_tier FROM t JOIN cat ON category_id = cat.id""",
            "t",
            "cat",
        ),
        "category_orphans": sql(
            """SELECT source_id, category_id FROM t
            WHERE category_id NOT IN (SELECT id FROM cat WHERE keywords IS NOT NULL)""",
            "t",
            "cat",
        ),
        # rollups
        "rollup_daily": sql(f"SELECT {ROLLUP} FROM r WHERE period_type = 'DAILY'", "r"),
        "rollup_weekly": sql(f"SELECT {ROLLUP} FROM r WHERE period_type = 'WEEKLY'", "r"),
        "rollup_monthly": sql(f"SELECT {ROLLUP} FROM r WHERE period_type = 'MONTHLY'", "r"),
        "rollup_full": sql(f"SELECT {ROLLUP} FROM r", "r"),
        "rollup_reversals": sql(
            f"SELECT {ROLLUP} FROM r WHERE total_reversed > 0", "r"
        ),
        "rollup_incremental": sql(f"SELECT {ROLLUP} FROM r", "r"),
        # spend queries
        "category_summary": sql(
            f"""SELECT code AS category_code, label AS category_label, {SUMS},
            CAST(sum(total_reversed) AS DOUBLE) AS total_reversed
            FROM r JOIN cat ON category_id = id WHERE period_type = 'MONTHLY'
            AND period_date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' GROUP BY ALL""",
            "r",
            "cat",
        ),
        "stored_summary": sql(
            f"""SELECT code AS category_code, label AS category_label, {SUMS},
            CAST(sum(total_reversed) AS DOUBLE) AS total_reversed
            FROM r JOIN cat ON category_id = id WHERE period_type = 'MONTHLY'
            AND period_date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' GROUP BY ALL""",
            "r",
            "cat",
        ),
        "by_category": sql(
            f"""SELECT code AS category_code, label AS category_label, {SUMS},
            CAST(sum(total_reversed) AS DOUBLE) AS total_reversed
            FROM d JOIN cat ON category_id = id GROUP BY ALL""",
            "d",
            "cat",
        ),
        "time_series": sql(
            f"SELECT CAST(period_date AS VARCHAR) AS period_date, {SUMS} FROM r WHERE period_type = 'WEEKLY' GROUP BY period_date",
            "r",
        ),
        "account_time_series": sql(
            f"""SELECT CAST(period_date AS VARCHAR) AS period_date, {SUMS} FROM r
            WHERE period_type = 'MONTHLY' AND account_id = '0042' AND period_date >= DATE '1996-01-01' GROUP BY period_date""",
            "r",
        ),
        "top_merchants": sql(
            """SELECT merchant_name, merchant_mcc, CAST(sum(amount) AS DOUBLE) AS total_spend,
            count(*) AS transaction_count FROM t WHERE merchant_mcc IS NOT NULL AND status = 'SETTLED'
            GROUP BY ALL ORDER BY sum(amount) DESC, merchant_name, merchant_mcc LIMIT 10""",
            "t",
        ),
        "merchant_totals": sql(
            """SELECT merchant_name, merchant_mcc, CAST(sum(amount) AS DOUBLE) AS total_spend,
            count(*) AS transaction_count FROM t GROUP BY ALL""",
            "t",
        ),
        # transaction queries
        "top_transactions": sql(
            f"""SELECT {CANONICAL} FROM t WHERE status = 'SETTLED'
            AND transacted_at >= TIMESTAMP '1997-01-01' AND transacted_at < TIMESTAMP '1999-01-01'
            ORDER BY t.amount DESC, source_id LIMIT 25""",
            "t",
        ),
        "list_transactions": sql(
            f"""SELECT {OUTPUT} FROM t JOIN cat ON category_id = cat.id WHERE account_id = 'cus_8'
            AND created_at >= TIMESTAMP '2024-01-03' AND created_at < TIMESTAMP '2024-01-29' """
            + ordered_page.format("created_at, source_id", 20, 20),
            "t",
            "cat",
        ),
        "list_transactions_meta": sql(
            META.format(page=1, size=20)
            + """ FROM t WHERE account_id = 'cus_8'
            AND created_at >= TIMESTAMP '2024-01-03' AND created_at < TIMESTAMP '2024-01-29'""",
            "t",
        ),
        "merchant_search": sql(
            f"SELECT {OUTPUT} FROM t JOIN cat ON category_id = cat.id WHERE contains(lower(merchant_name), 'ring') "
            + ordered_page.format("merchant_name, source_id", 50, 100),
            "t",
            "cat",
        ),
        "stored_search": sql(
            f"SELECT {OUTPUT} FROM t JOIN cat ON category_id = cat.id WHERE contains(lower(merchant_name), 'ring') "
            + ordered_page.format("merchant_name, source_id", 50, 100),
            "t",
            "cat",
        ),
        "merchant_search_meta": sql(
            META.format(page=2, size=50) + " FROM t WHERE contains(lower(merchant_name), 'ring')", "t"
        ),
        "deep_page": sql(
            f"SELECT {CANONICAL} FROM t " + ordered_page.format("t.amount, source_id", 100, 10000), "t"
        ),
        "list_transactions_after": sql(
            f"""SELECT {OUTPUT} FROM t JOIN cat ON category_id = cat.id
            WHERE t.amount > 20000 OR t.amount = 20000 AND source_id > 'CN-1-1' """
            + ordered_page.format("t.amount, source_id", 50, 0),
            "t",
            "cat",
        ),
        "stored_listing": sql(
            f"""SELECT {OUTPUT} FROM t JOIN cat ON category_id = cat.id WHERE account_id = 'cus_8'
            AND transacted_at >= TIMESTAMP '2024-01-03' AND transacted_at < TIMESTAMP '2024-01-29' """
            + ordered_page.format("created_at, source_id", 30, 0),
            "t",
            "cat",
        ),
        "stored_by_id": sql(
            f"SELECT {OUTPUT} FROM t JOIN cat ON category_id = cat.id WHERE source_id = 'pi_7'", "t", "cat"
        ),
        "transaction_by_id": sql(
            f"SELECT {OUTPUT} FROM t JOIN cat ON category_id = cat.id WHERE source_id = 'pi_7'", "t", "cat"
        ),
        # comparison
        "compare_periods": sql(
            f"""SELECT 'current' AS period, CAST({YEAR[0]} AS VARCHAR) AS period_from,
            CAST({YEAR[1]} AS VARCHAR) AS period_to, CAST(coalesce(sum(cur), 0) AS DOUBLE) AS total_spend,
            CAST(coalesce(sum(cur_n), 0) AS BIGINT) AS transaction_count FROM cmp
            UNION ALL SELECT 'previous', CAST({YEAR_BEFORE[0]} AS VARCHAR), CAST({YEAR_BEFORE[1]} AS VARCHAR),
            CAST(coalesce(sum(prev), 0) AS DOUBLE), CAST(coalesce(sum(prev_n), 0) AS BIGINT) FROM cmp""",
            "cmp",
        ),
        "compare_delta": sql(
            f"""SELECT CAST(round(cur - prev, 2) AS DOUBLE) AS absolute_spend,
            {percent('cur - prev', 'prev')} AS spend_percentage, cur_n - prev_n AS count_absolute,
            CASE WHEN cur > prev THEN 'INCREASE' WHEN cur < prev THEN 'DECREASE' ELSE 'FLAT' END AS direction
            FROM (SELECT sum(cur) AS cur, sum(prev) AS prev, CAST(sum(cur_n) AS BIGINT) AS cur_n,
                CAST(sum(prev_n) AS BIGINT) AS prev_n FROM cmp)""",
            "cmp",
        ),
        "compare_by_category": sql(_breakdown("brk"), "brk"),
        "compare_by_account": sql(_breakdown("brk_a", "account_id,"), "brk_a"),
        "compare_series": sql(
            f"""SELECT CAST(c.period_date AS VARCHAR) AS period_date, CAST(c.spend AS DOUBLE) AS current_spend,
            CAST(coalesce(p.spend, 0) AS DOUBLE) AS previous_spend
            FROM (SELECT period_date, sum(total_spend) AS spend FROM r WHERE period_type = 'MONTHLY'
                AND period_date BETWEEN {YEAR[0]} AND {YEAR[1]} GROUP BY ALL) c
            LEFT JOIN (SELECT period_date, sum(total_spend) AS spend FROM r WHERE period_type = 'MONTHLY'
                AND period_date BETWEEN {YEAR_BEFORE[0]} AND {YEAR_BEFORE[1]} GROUP BY ALL) p
            ON month(c.period_date) = month(p.period_date)""",
            "r",
        ),
        "compare_report": sql(
            f"""SELECT CAST(cur AS DOUBLE) AS current_spend, CAST(cur_n AS BIGINT) AS current_count,
            CAST(prev AS DOUBLE) AS previous_spend, CAST(prev_n AS BIGINT) AS previous_count,
            {percent('cur - prev', 'prev')} AS spend_percentage,
            CASE WHEN cur > prev THEN 'INCREASE' WHEN cur < prev THEN 'DECREASE' ELSE 'FLAT' END AS direction,
            coalesce((SELECT string_agg(concat_ws(':', category_code, CAST(cur AS DECIMAL(38,4)), CAST(prev AS DECIMAL(38,4)),
                CAST({percent('cur - prev', 'prev')} AS DECIMAL(24,2)), CAST({percent('cur', 'cur_total')} AS DECIMAL(24,2))), ','
                ORDER BY cur DESC, category_code) FROM brk), '') AS by_category,
            coalesce((SELECT string_agg(concat_ws(':', c.period_date, CAST(c.spend AS DECIMAL(38,4)), CAST(coalesce(p.spend, 0) AS DECIMAL(38,4))), ','
                ORDER BY c.period_date) FROM months c LEFT JOIN months p ON p.period_date = c.period_date - INTERVAL 1 YEAR
                WHERE c.period_date BETWEEN {YEAR[0]} AND {YEAR[1]}), '') AS time_series,
            coalesce((SELECT string_agg(category_code || ':' || reason, ',' ORDER BY category_code || ':' || reason)
                FROM ({_anomalies("brk", "1", "")})), '') AS anomalies
            FROM (SELECT coalesce(sum(cur), 0) AS cur, coalesce(sum(prev), 0) AS prev, coalesce(sum(cur_n), 0) AS cur_n,
                coalesce(sum(prev_n), 0) AS prev_n FROM cmp)""",
            "cmp",
            "brk",
            "months",
        ),
        "anomalies": sql(_anomalies("brk_a", "account_id", "account_id,"), "brk_a"),
        # category dimension
        "list_categories": sql(
            """SELECT external_id, code, label, path, array_to_string(mcc_codes, ',') AS mcc_codes
            FROM pcat ORDER BY path, code LIMIT 20 OFFSET 40""",
            "pcat",
        ),
        "list_categories_meta": sql(META.format(page=2, size=20) + " FROM pcat", "pcat"),
        "category_by_id": sql(
            """SELECT external_id, code, label, path, array_to_string(mcc_codes, ',') AS mcc_codes
            FROM pcat WHERE code = 'large_brand_7'""",
            "pcat",
        ),
        "category_by_mcc": sql(
            """SELECT external_id, code, label, path, array_to_string(mcc_codes, ',') AS mcc_codes
            FROM pcat WHERE list_has_any(mcc_codes, ['5007', '5011']) ORDER BY label, code LIMIT 1000""",
            "pcat",
        ),
        "category_tree": sql(
            """SELECT c.code, c.path, CAST(len(string_split(c.path, '.')) AS INTEGER) AS depth,
            p.code AS parent_code, p.label AS parent_label FROM pcat c LEFT JOIN pcat p ON c.parent_id = p.id""",
            "pcat",
        ),
        "root_categories": sql("SELECT id, code, label FROM pcat WHERE parent_id IS NULL", "pcat"),
        # streams, against the batch answer
        "stream_dedup": sql(f"SELECT {CANONICAL} FROM firsts", "firsts"),
        "stream_dedup_ttl": sql("SELECT DISTINCT source_id, account_id FROM firsts", "firsts"),
        "stream_accepted": sql(f"SELECT {CANONICAL} FROM firsts", "firsts"),
        "stream_dedup_forgets": sql(
            """SELECT CAST(batch_id AS BIGINT) AS batch_id, source_type, outcome, count(*) AS records
            FROM firsts, (VALUES (0, 'ACCEPTED'), (2, 'DUPLICATE')) AS b(batch_id, outcome) GROUP BY ALL""",
            "firsts",
        ),
        "stream_payment_repeats": sql(f"SELECT {CANONICAL} FROM life", "life"),
        "stream_payment_outcomes": sql(
            """SELECT 'PAYMENT_PROCESSOR' AS source_type, outcome, CAST(sum(n) AS BIGINT) AS records FROM (
            SELECT 'FAILED' AS outcome, CASE WHEN coalesce(amount > 0 AND amount <= 100000, false) THEN 0 ELSE 1 END AS n FROM payment_n
            UNION ALL SELECT 'ACCEPTED', 1 FROM life
            UNION ALL SELECT 'DUPLICATE', CASE WHEN amount > 0 AND amount <= 100000 THEN 1 ELSE 0 END FROM payment_n
            UNION ALL SELECT 'DUPLICATE', -1 FROM life
            UNION ALL SELECT 'REPEATED', CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END FROM events)
            GROUP BY ALL HAVING outcome <> 'REPEATED' OR sum(n) > 0""",
            "life",
        ),
        "dead_letter_stages": sql(
            """SELECT source_id, 'validation' AS stage, CASE WHEN amount > 0 THEN 'amount_too_large' ELSE 'amount_not_positive' END AS reject_reason
            FROM u WHERE NOT coalesce(amount > 0 AND amount <= 100000, false)
            UNION ALL
            SELECT * FROM (SELECT source_id,
                CASE WHEN failed THEN 'model' WHEN NOT known THEN 'categorisation' WHEN ending = '41' THEN 'transaction' WHEN ending = '37' THEN 'event' END AS stage,
                CASE WHEN failed THEN 'model_failed' WHEN NOT known THEN 'category_missing' WHEN ending = '41' THEN 'date_out_of_range' WHEN ending = '37' THEN 'event_too_large' END AS reject_reason
                FROM (SELECT source_id, ending, rule_id IS NULL AND widget AND amount > 90000 AS failed,
                    rule_id IS NOT NULL OR (widget AND amount <= 50000) AS known FROM (
                    SELECT source_id, amount, right(source_id, 2) AS ending, right(source_id, 2) <> '37' AND contains(f.merchant_name, 'widget') AS widget,
                        coalesce(m.id, CASE WHEN right(source_id, 2) <> '37' THEN k.id END) AS rule_id
                        FROM firsts f LEFT JOIN mcc_rule m ON f.merchant_mcc = m.mcc LEFT JOIN merchant_kw k ON f.merchant_name = k.merchant_name)))
            WHERE stage IS NOT NULL""",
            "u",
            "t",
        ),
        "stream_transactions": sql(
            "SELECT source_id, CAST(amount AS DOUBLE) AS amount, category_id, category_tier FROM t", "t"
        ),
        "stream_rollup": sql(
            """SELECT account_id, category_id, CAST(date_trunc('month', transacted_at) AS DATE)::VARCHAR AS period_date,
            'MONTHLY' AS period_type,
            CAST(sum(CASE WHEN status = 'SETTLED' THEN amount ELSE 0 END) AS DOUBLE) AS total_spend,
            CAST(sum(CASE WHEN status = 'SETTLED' THEN 1 ELSE 0 END) AS BIGINT) AS transaction_count,
            CAST(sum(CASE WHEN status = 'REVERSED' THEN amount ELSE 0 END) AS DOUBLE) AS total_reversed
            FROM t WHERE status IN ('SETTLED', 'REVERSED') GROUP BY ALL""",
            "t",
        ),
        "stream_outcomes": sql(
            """SELECT source_type, outcome, CAST(sum(n) AS BIGINT) AS records FROM (
            SELECT source_type, 'FAILED' AS outcome, CASE WHEN coalesce(amount > 0 AND amount <= 100000, false) THEN 0 ELSE 1 END AS n FROM u
            UNION ALL SELECT source_type, 'ACCEPTED', 1 FROM firsts
            UNION ALL SELECT source_type, 'DUPLICATE', CASE WHEN place > 1 THEN 1 ELSE 0 END FROM (SELECT source_type,
                row_number() OVER (PARTITION BY source_id ORDER BY s1, s2, s3, s4) AS place FROM ok)) GROUP BY ALL""",
            "u",
            "ok",
            "firsts",
        ),
        "stream_counters": sql(
            """SELECT source_type, CASE WHEN coalesce(amount > 0 AND amount <= 100000, false) THEN 'success' ELSE 'failure' END AS result,
            count(*) AS records FROM u GROUP BY ALL""",
            "u",
        ),
        "stream_age_guard": sql(COUNTS, "v", "numbered"),
        "windowed_rollup": sql(
            """SELECT account_id, category_id, CAST(date_trunc('week', transacted_at) AS DATE)::VARCHAR AS period_date,
            'WEEKLY' AS period_type,
            CAST(sum(CASE WHEN status = 'SETTLED' THEN amount ELSE 0 END) AS DOUBLE) AS total_spend,
            CAST(sum(CASE WHEN status = 'SETTLED' THEN 1 ELSE 0 END) AS BIGINT) AS transaction_count,
            CAST(sum(CASE WHEN status = 'REVERSED' THEN amount ELSE 0 END) AS DOUBLE) AS total_reversed
            FROM t WHERE status IN ('SETTLED', 'REVERSED') GROUP BY ALL""",
            "t",
        ),
    }
