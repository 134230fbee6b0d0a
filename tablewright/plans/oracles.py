"""The registered queries' results as SQL over the same tables."""

from __future__ import annotations

from tablewright.catalog import ForeignKey
from tablewright.catalogs import SHOP, STAR
from tablewright.functions.draws import MASK31, MASK32, MIX_MULTIPLIERS, MIX_SHIFTS, stream_constants
from tablewright.functions.generators import DEFAULT_AS_OF
from tablewright.operators.pools import TEMPLATES, USER_NAMES, USER_TEMPLATE
from tablewright.plans.given import SCHEMAS, FAULTS, REPEATED, REPLY
from tablewright.plans.queries import EDGES, ENUM_VALUES, QUERIES, SEED

AS_OF = int(DEFAULT_AS_OF.timestamp())
ORDERS = "FROM (SELECT o_orderkey AS id FROM orders)"
CUSTOMERS = "(SELECT count(*) FROM customer)"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# Draws


def u32(tag: str, row_id: str) -> str:
    low, high, offset = stream_constants(SEED, tag)
    x = f"(xor(({row_id} & {MASK32}) * {low} + {offset}, ({row_id} >> 32) * {high}) & {MASK32})"
    for shift, multiplier in zip(MIX_SHIFTS, MIX_MULTIPLIERS):
        x = f"((xor({x}, {x} >> {shift}) * {multiplier}) & {MASK32})"
    return f"xor({x}, {x} >> {MIX_SHIFTS[-1]})"


def u63(tag: str, row_id: str) -> str:
    return f"({u32(tag, row_id)} * {MASK31 + 1} + ({u32(tag + '/low', row_id)} & {MASK31}))"


def draw(tag: str, row_id: str, n) -> str:
    return f"(({u32(tag, row_id)} * {n}) >> 32)"


def chance(tag: str, row_id: str, probability: float) -> str:
    return f"({u32(tag, row_id)} < {int(probability * 2**32)})"


def element(values, position: str) -> str:
    listed = ", ".join(text(v) for v in values)
    return f"([{listed}])[{position} + 1]"


def cents(low: int, high: int, tag: str, row_id: str) -> str:
    return f"(({low} + {draw(tag, row_id, high - low + 1)})::DOUBLE / 100)"


def moment(range_days: int, tag: str, row_id: str) -> str:
    return f"make_timestamp(({AS_OF} - {draw(tag, row_id, range_days * 86400)}) * 1000000)"


def phone(row_id: str) -> str:
    return f"'9' || lpad(({row_id} % 1000000000)::VARCHAR, 9, '0')"


def generated(value: str) -> str:
    return f"SELECT id, {value} AS value {ORDERS}"


# Faulty tables


def faulty(*names: str) -> str:
    """WITH clause of the tables with faults, as d_<name>."""
    parts = []
    for name in names or STAR.tables:
        faults = ", ".join(f"{e} AS {c}" for c, e in FAULTS.get(name, {}).items())
        source = f"SELECT * REPLACE ({faults}) FROM {name}" if faults else f"SELECT * FROM {name}"
        if name in REPEATED:
            source += f" UNION ALL SELECT * FROM {name} WHERE {REPEATED[name]}"
        parts.append(f"d_{name} AS ({source})")
    return "WITH " + ", ".join(parts)


def edge_names(e: ForeignKey) -> str:
    return (
        f"'{e.child}' AS child_table, '{e.column}' AS fk_column, "
        f"'{e.parent}' AS parent_table, '{e.parent_column}' AS parent_column"
    )


def matched(e: ForeignKey) -> str:
    return f"{e.column} IN (SELECT {e.parent_column} FROM d_{e.parent})"


def percent(part: str, whole: str) -> str:
    return (
        f"round(CASE WHEN {whole} > 0 THEN {part} * 100.0::DOUBLE / {whole} ELSE 0::DOUBLE END, 2)"
    )


def checked() -> str:
    """WITH clause ending in ``checked``, one row per reference."""
    rows = " UNION ALL ".join(
        f"SELECT {edge_names(e)}, count(*)::BIGINT AS total, "
        f"count(*) FILTER (WHERE {matched(e)})::BIGINT AS valid, "
        f"count(*) FILTER (WHERE {e.column} IS NULL)::BIGINT AS nulls FROM d_{e.child}"
        for e in STAR.edges
    )
    return (
        f"{faulty()}, counted AS ({rows}), checked AS (SELECT child_table, fk_column, "
        "parent_table, parent_column, total, valid, (total - valid)::BIGINT AS orphaned, nulls, "
        f"{percent('valid', 'total')} AS valid_pct, "
        "CASE WHEN total = valid THEN 'OK' ELSE 'FAIL' END AS status FROM counted)"
    )


def cleaned() -> str:
    """WITH clause of the cleaned tables, as c_<name>, parents first."""
    parts = []
    for name in STAR.load_order():
        kept = " AND ".join(
            f"{e.column} IN (SELECT {e.parent_column} FROM c_{e.parent})"
            for e in STAR.tables[name].foreign_keys
        )
        parts.append(f"c_{name} AS (SELECT * FROM d_{name} WHERE {kept or 'true'})")
    return f"{faulty()}, " + ", ".join(parts)


def orphans_of(name: str) -> str:
    e = EDGES[name]
    return (
        f"{faulty(e.child, e.parent)} SELECT c.* FROM d_{e.child} c LEFT JOIN "
        f"(SELECT DISTINCT {e.parent_column} AS pk FROM d_{e.parent}) p ON c.{e.column} = p.pk "
        "WHERE p.pk IS NULL"
    )


def cleaned_lineitem() -> str:
    kept = " AND ".join(matched(e) for e in STAR.tables["lineitem"].foreign_keys)
    return f"{faulty('orders', 'part', 'supplier', 'lineitem')} SELECT * FROM d_lineitem WHERE {kept}"


# Declared columns


def declared(name: str, source: str | None = None) -> str:
    """A given table with keys as BIGINT, as the declared schema reads them."""
    table = STAR.tables[name]
    columns = [
        f"{c}::BIGINT AS {c}" if kind in ("pk", "fk") else c for c, kind in table.kinds.items()
    ]
    return f"SELECT {', '.join(columns)} FROM {source or name}"


SPOILED = "CASE WHEN c_mktsegment = 'MACHINERY' THEN 'x' ELSE c_acctbal::VARCHAR END"


# Statements


def literal(column: str, kind: str) -> str:
    if kind == "decimal":
        value = f"{column}::DECIMAL(19,2)::VARCHAR"
    elif kind in ("pk", "fk", "int", "long"):
        value = f"{column}::VARCHAR"
    else:
        value = f"'''' || replace({column}::VARCHAR, '''', '''''') || ''''"
    return f"CASE WHEN {column} IS NULL OR {column}::VARCHAR = '' THEN 'NULL' ELSE {value} END"


def statements(name: str, columns: list[str]) -> str:
    kinds = STAR.tables[name].kinds
    listed = ", ".join(f"[{c}]" for c in columns)
    values = " || ', ' || ".join(literal(c, kinds[c]) for c in columns)
    return f"'INSERT INTO [SalesLT].[{name}] ({listed}) VALUES (' || {values} || ');'"


# Column order of the given tables, which INSERT statements keep.
GIVEN_COLUMNS = {
    name: " ".join(column.split(" ")[0] for column in schema.split(", "))
    for name, schema in SCHEMAS.items()
}


def script(with_order: bool) -> str:
    order = STAR.load_order()
    parts = []
    for number, name in enumerate(order, start=1):
        head = [
            text(f"-- File Order: {number}"),
            text(f"-- Table: {name}"),
            text(f"-- INSERT statements for {name}"),
            f"'-- Generated: ' || (SELECT count(*) FROM {name}) || ' rows'",
            text(f"-- Execute in order: {number:02d}_{name}.sql"),
        ]
        stem = f"{number} AS load_order, "
        parts.append(f"SELECT {stem} unnest([{', '.join(head)}]) AS line")
        # Text with line breaks makes one statement several lines.
        lines = f"unnest(string_split({statements(name, GIVEN_COLUMNS[name].split())}, chr(10)))"
        parts.append(f"SELECT {stem} {lines} AS line FROM {name}")
    if with_order:
        total = " + ".join(f"(SELECT count(*) FROM {n})" for n in order)
        foot = [
            f"'-- Total rows inserted: ' || format('{{:,}}', {total})",
            text(f"-- Total tables: {len(order)}"),
            text("-- Schema: SalesLT"),
        ]
        parts.append(f"SELECT {len(order) + 1} AS load_order, unnest([{', '.join(foot)}]) AS line")
    picked = "load_order, line" if with_order else "line"
    return f"SELECT {picked} FROM ({' UNION ALL '.join(parts)})"


# Pools


def pool_value(template: str) -> str:
    """Pattern with {i} and {group} filled in from columns ``i`` and ``grp``."""
    return f"replace(replace({text(template)}, '{{i}}', i::VARCHAR), '{{group}}', grp)"


def pool_groups() -> str:
    by_type = "(SELECT p_type AS grp, count(*) AS size FROM part GROUP BY 1)"
    by_city = (
        "(SELECT n_name AS grp, count(*) AS size FROM customer "
        "JOIN nation ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name)"
    )
    return f"groups AS (SELECT 'user_names' AS pool, '' AS grp, count(*) AS size FROM customer " + "".join(
        f"UNION ALL SELECT '{pool}', grp, size FROM {source} "
        for pool, source in [
            ("product_names", by_type),
            ("brands", by_type),
            ("descriptions", by_type),
            ("addresses", by_city),
            ("warehouse_names", by_city),
        ]
    ) + ")"


def pool_expanded(groups: str) -> str:
    cases = " ".join(f"WHEN pool = '{p}' THEN {pool_value(t)}" for p, t in TEMPLATES.items())
    named = len(USER_NAMES)
    user = USER_TEMPLATE.replace("{i}", "")
    return (
        f"SELECT pool, grp, i AS idx, CASE WHEN pool = 'user_names' AND i < {named} "
        f"THEN {element(USER_NAMES, 'i')} WHEN pool = 'user_names' THEN '{user}' || (i - {named}) "
        f"{cases} END AS value "
        f"FROM (SELECT pool, grp, unnest(range(size::BIGINT)) AS i FROM {groups})"
    )


BRANDS = "(SELECT DISTINCT p_type AS grp, p_brand AS value FROM part)"


def items(key: str, count: int, source: str, kept: str) -> str:
    """Items of replies in (kept, response)."""
    return f"""
      SELECT {kept}, pos::INTEGER AS pos, kept_items[pos + 1] AS item
      FROM (SELECT {kept}, kept_items, unnest(range(len(kept_items))) AS pos FROM (
        SELECT {kept}, (CASE
            WHEN shape = 'OBJECT' AND listed IS NULL THEN []::VARCHAR[]
            WHEN shape = 'OBJECT' AND listed = 'ARRAY'
              THEN CAST(json_extract(response, '$.{key}') AS VARCHAR[])
            WHEN len(quoted) > 0 THEN quoted
            ELSE numbered END)[1:{count}] AS kept_items
        FROM (
          SELECT *,
            CASE WHEN json_valid(response) THEN json_type(response) END AS shape,
            CASE WHEN json_valid(response) THEN json_type(response, '$.{key}') END AS listed,
            regexp_extract_all(response, '["'']([^"'']+)["'']', 1) AS quoted,
            regexp_extract_all(response, '(?m)^\\s*\\d+\\.\\s*(.+)$', 1) AS numbered
          FROM {source})))"""


# Profiles and statistics

PROFILED = {
    "o_orderkey": "bigint",
    "o_custkey": "bigint",
    "o_orderstatus": "string",
    "o_totalprice": "double",
    "o_orderdate": "timestamp_ntz",
    "o_orderpriority": "string",
}


def profiled() -> str:
    rows = []
    for column, kind in PROFILED.items():
        rows.append(
            f"SELECT '{column}' AS column_name, '{kind}' AS data_type, true AS nullable, "
            f"count(*)::BIGINT AS row_count, (count(*) - count({column}))::BIGINT AS null_rows, "
            f"min({column})::VARCHAR AS min_value, max({column})::VARCHAR AS max_value, "
            f"count(DISTINCT {column})::BIGINT AS distinct_values FROM d_orders"
        )
    return f"{faulty('orders')} " + " UNION ALL ".join(rows)


def profiled_bounded() -> str:
    rows = []
    for column, kind in PROFILED.items():
        number, true = f"count(DISTINCT {column})::BIGINT", "true"
        measures = (
            "count(*)::BIGINT", f"(count(*) - count({column}))::BIGINT",
            f"min({column})::VARCHAR", f"max({column})::VARCHAR",
        )
        merged = ("NULL", "NULL", "NULL", "NULL") if column == "o_orderpriority" else measures
        if column == "o_orderpriority":
            true = "NULL"
        rows.append(
            f"SELECT '{column}' AS column_name, '{kind}' AS data_type, {measures[0]} AS row_count, "
            f"{measures[1]} AS null_rows, {measures[2]} AS min_value, {measures[3]} AS max_value, "
            f"{number} >= 5000 AS estimated, CASE WHEN {number} < 5000 THEN {number} END AS distinct_values, "
            f"true AS within, {true}::BOOLEAN AS merged_within, {merged[0]}::BIGINT AS merged_rows, "
            f"{merged[1]}::BIGINT AS merged_nulls, {merged[2]}::VARCHAR AS merged_min, "
            f"{merged[3]}::VARCHAR AS merged_max FROM d_orders"
        )
    return f"{faulty('orders')} " + " UNION ALL ".join(rows)


def counts(tables) -> str:
    return " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*)::BIGINT AS row_count FROM {t}" for t in tables
    )


def stats() -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {t})::BIGINT AS row_count, "
        f"(SELECT count(*) FROM (DESCRIBE {t}))::INTEGER AS column_count, 'OK' AS status"
        for t in STAR.tables
    )
    return f"{rows} UNION ALL SELECT 'archive', NULL, NULL, 'MISSING'"


def fan_in(e: ForeignKey) -> str:
    return (
        f"SELECT {edge_names(e)}, count(*)::BIGINT AS parents, "
        "count(*) FILTER (WHERE n > 0)::BIGINT AS referenced, "
        "count(*) FILTER (WHERE n = 0)::BIGINT AS never_referenced, "
        "min(n)::BIGINT AS min_children, max(n)::BIGINT AS max_children, "
        "round(sum(n)::DOUBLE / count(*), 4) AS avg_children FROM ("
        f"SELECT p.pk, count(c.fk) AS n FROM (SELECT DISTINCT {e.parent_column} AS pk "
        f"FROM d_{e.parent} WHERE {e.parent_column} IS NOT NULL) p "
        f"LEFT JOIN (SELECT {e.column} AS fk FROM d_{e.child}) c ON p.pk = c.fk GROUP BY p.pk)"
    )


def sample_row() -> str:
    tag = "Sample."
    n = "(SELECT count(*) FROM orders)"
    return f"""
      SELECT {draw(tag + 'customer_id', 'id', CUSTOMERS)} AS customer_id,
        id AS sample_id,
        CASE WHEN NOT {chance(tag + 'parent_id/null', 'id', 0.7)}
             THEN {draw(tag + 'parent_id', 'id', n)} END AS parent_id,
        'name_' || id AS name, 'user_' || id || '@example.com' AS email, {phone('id')} AS phone,
        {element(ENUM_VALUES, draw(tag + 'method', 'id', len(ENUM_VALUES)))} AS method,
        {cents(10, 2000, tag + 'price', 'id')} AS price,
        {cents(-100000000, 200000000, tag + 'balance', 'id')} AS balance,
        {chance(tag + 'is_active', 'id', 0.9)} AS is_active,
        {moment(365, tag + 'created', 'id')} AS created,
        (1 + {draw(tag + 'quantity', 'id', 4)})::INTEGER AS quantity
      FROM (SELECT unnest(range({n})) AS id)"""


def shop() -> str:
    rows = ", ".join(
        f"('{t.name}', {t.rows}, {len(t.kinds)})" for t in SHOP.tables.values()
    )
    orders = SHOP.tables["Orders"].rows
    return (
        f"SELECT name AS table_name, greatest(1, rows * (SELECT count(*) FROM orders) // {orders})"
        "::BIGINT AS row_count, columns::INTEGER AS column_count, 0::BIGINT AS orphaned "
        f"FROM (VALUES {rows}) t(name, rows, columns)"
    )


# Which keys each key of a tree leads to, itself only around a ring.
REACHED = """reach AS (
        SELECT p_partkey AS start, parent_key AS goal FROM tree
        WHERE parent_key IN (SELECT p_partkey FROM tree)
        UNION
        SELECT start, parent_key FROM reach JOIN tree ON goal = p_partkey
        WHERE parent_key IN (SELECT p_partkey FROM tree)
      ), on_ring AS (
        SELECT start AS p_partkey FROM reach WHERE start = goal
      ), ring AS (
        SELECT start AS p_partkey, min(goal::VARCHAR) AS low
        FROM reach WHERE goal IN (SELECT p_partkey FROM on_ring) GROUP BY start
      )"""


def self_check() -> str:
    parent = draw("self.parent", "p_partkey", "2 * (SELECT count(*) FROM part)")
    return f"""
      WITH RECURSIVE tree AS (SELECT p_partkey, CASE WHEN NOT {chance('self.null', 'p_partkey', 0.3)}
                           THEN {parent} END AS parent_key FROM part),
      rooted AS (
        SELECT p_partkey, 0 AS depth FROM tree WHERE parent_key IS NULL
        UNION ALL SELECT t.p_partkey, depth + 1 FROM tree t JOIN rooted r ON t.parent_key = r.p_partkey
      ), {REACHED}
      SELECT count(*)::BIGINT AS total, (count(*) - count(parent_key))::BIGINT AS nulls,
        count(p.pk)::BIGINT AS valid, (count(parent_key) - count(p.pk))::BIGINT AS orphaned,
        (SELECT count(DISTINCT low) FROM ring JOIN on_ring USING (p_partkey))::BIGINT AS rings,
        (SELECT max(depth) FROM rooted)::BIGINT AS max_depth,
        (count(*) - (SELECT count(*) FROM rooted))::BIGINT AS unrooted
      FROM tree LEFT JOIN (SELECT p_partkey AS pk FROM part) p ON parent_key = p.pk"""


HIERARCHY = f"""WITH RECURSIVE tree AS (
        SELECT p_partkey, CASE WHEN p_partkey % 50 >= 45 THEN p_partkey - p_partkey % 5 + (p_partkey + 1) % 5
          WHEN p_partkey > 5 THEN p_partkey // 3 END AS parent_key
        FROM part WHERE p_partkey % 7 <> 0
      ), ended AS (
        SELECT p_partkey, CASE WHEN parent_key IS NULL THEN 'root' ELSE 'missing' END AS state,
          CASE WHEN parent_key IS NULL THEN 0 ELSE 1 END AS depth, coalesce(parent_key, p_partkey) AS last
        FROM tree WHERE parent_key IS NULL OR parent_key NOT IN (SELECT p_partkey FROM tree)
        UNION ALL
        SELECT t.p_partkey, state, depth + 1, last FROM tree t JOIN ended e ON t.parent_key = e.p_partkey
      ), {REACHED}
      SELECT p_partkey::VARCHAR AS node, parent_key::VARCHAR AS parent, coalesce(state, 'ring') AS state,
        depth::BIGINT AS depth, coalesce(last::VARCHAR, low) AS last,
        p_partkey IN (SELECT p_partkey FROM on_ring) AS on_ring
      FROM tree LEFT JOIN ended USING (p_partkey) LEFT JOIN ring USING (p_partkey)"""


def level_totals() -> str:
    level = " ".join(f"WHEN '{t}' THEN '{n}'" for t, n in STAR.levels().items())
    return f"""
      SELECT coalesce(level, 'TOTAL') AS level_name, count(*)::BIGINT AS table_count,
        sum(row_count)::BIGINT AS row_count
      FROM (SELECT CASE table_name {level} END AS level, row_count FROM ({counts(STAR.tables)}))
      GROUP BY ROLLUP (level)"""


SUPPLIER = EDGES["lineitem.l_suppkey"]
LOOKUP = f"""{faulty('customer')}, keys AS (
      SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS idx, c_custkey FROM d_customer)"""
ISSUES = "child_table, fk_column, parent_table, parent_column"

ORACLES: dict[str, str] = {
    "range_source": "SELECT unnest(range((SELECT count(*) FROM orders))) AS id",
    "scan_csv": declared("orders"),
    "scan_csv_split": declared("customer"),
    "scan_parquet": "SELECT * FROM lineitem",
    "scan_json": declared("supplier"),
    "scan_csv_strings": f"SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_nationkey::VARCHAR AS c_nationkey, "
    f"{SPOILED} AS c_acctbal, c_mktsegment FROM customer",
    "scan_typed": declared(
        "customer",
        f"(SELECT * REPLACE (TRY_CAST({SPOILED} AS DECIMAL(19,2))::DOUBLE AS c_acctbal) FROM customer)",
    ),
    "scan_typed_failures": "SELECT unnest(['c_nationkey', 'c_custkey', 'c_name', 'c_acctbal', "
    "'c_mktsegment']) AS column_name, unnest([0, 0, 0, (SELECT count(*) FROM customer "
    "WHERE c_mktsegment = 'MACHINERY'), 0])::BIGINT AS failed_casts",
    "sink_csv": declared("customer"),
    "sink_parquet": declared("lineitem"),
    "sink_json": declared("part"),
    "sink_cleaned": faulty("customer", "orders")
    + " "
    + declared("orders", f"(SELECT * FROM d_orders WHERE {matched(EDGES['orders.o_custkey'])})"),
    "sink_sql_text": script(with_order=False),
    "sink_sql_all": script(with_order=True),
    "gen_pk": generated("id"),
    "gen_string": generated("'name_' || id"),
    "gen_email": generated("'user_' || id || '@example.com'"),
    "gen_phone": generated(phone("id")),
    "gen_enum": generated(element(ENUM_VALUES, draw("gen.enum", "id", len(ENUM_VALUES)))),
    "gen_decimal": generated(cents(10, 2_000_000, "gen.decimal", "id")),
    "gen_boolean": generated(chance("gen.boolean", "id", 0.9)),
    "gen_timestamp": generated(moment(1500, "gen.timestamp", "id")),
    "gen_int": generated(f"(1 + {draw('gen.int', 'id', 4)})::INTEGER"),
    "gen_pool_name": f"""
      WITH pool AS (SELECT row_number() OVER (ORDER BY c_name) - 1 AS idx, c_name FROM customer)
      SELECT id, c_name AS name FROM (
        SELECT id, {draw('gen.name', 'id', CUSTOMERS)} AS slot {ORDERS}) JOIN pool ON slot = idx""",
    "gen_pool_brand": f"""
      WITH pool AS (SELECT grp, value, row_number() OVER (PARTITION BY grp ORDER BY value) - 1 AS idx,
                      count(*) OVER (PARTITION BY grp) AS size FROM {BRANDS}),
      sizes AS (SELECT DISTINCT grp, size FROM pool),
      slots AS (SELECT p_partkey, p_type, {u63('gen.brand', 'p_partkey')} % size AS slot
                FROM part JOIN sizes ON p_type = grp)
      SELECT p_partkey, p_type, value AS brand FROM slots JOIN pool ON p_type = grp AND slot = idx""",
    "gen_nullable_fk": generated(
        f"CASE WHEN NOT {chance('gen.parent/null', 'id', 0.7)} "
        f"THEN {draw('gen.parent', 'id', CUSTOMERS)} END"
    ),
    "gen_table": sample_row(),
    "gen_dataset": shop(),
    "fk_sample_dense": generated(draw("gen.customer", "id", CUSTOMERS)),
    "fk_sample_lookup": f"""{LOOKUP}
      SELECT id, c_custkey AS value FROM (
        SELECT id, {draw('gen.lookup', 'id', CUSTOMERS)} AS slot {ORDERS}) JOIN keys ON slot = idx""",
    "dense_index": f"{LOOKUP} SELECT idx, c_custkey FROM keys",
    "fk_valid_count": f"{faulty('supplier', 'lineitem')}, counted AS (SELECT count(*)::BIGINT AS total, "
    f"count(*) FILTER (WHERE {matched(SUPPLIER)})::BIGINT AS valid FROM d_lineitem) SELECT total, valid, "
    f"(total - valid)::BIGINT AS orphaned, {percent('valid', 'total')} AS valid_pct FROM counted",
    "fk_validate_all": f"{checked()} SELECT * FROM checked",
    "fk_validate_append": f"{checked()} SELECT * FROM checked",
    "fk_issues": f"{checked()} SELECT {ISSUES}, orphaned FROM checked WHERE orphaned > 0",
    "fk_summary": f"{checked()} SELECT sum(total)::BIGINT AS scanned, sum(valid)::BIGINT AS valid, "
    "sum(orphaned)::BIGINT AS orphaned, sum(orphaned) = 0 AS is_valid FROM checked",
    "fk_orphan_rows": orphans_of("orders.o_custkey"),
    "fk_orphan_rows_by_key": orphans_of("lineitem.l_orderkey"),
    "fk_orphan_count": "SELECT count(*)::BIGINT AS orphaned_records FROM "
    f"({orphans_of('lineitem.l_partkey')})",
    "fk_final_status": f"{checked()} SELECT count(*) FILTER (WHERE orphaned = 0 AND "
    "parent_table <> 'documents')::BIGINT AS valid_fks, count(*)::BIGINT AS total_fks, "
    "sum(CASE WHEN parent_table <> 'documents' THEN orphaned ELSE 0 END)::BIGINT AS orphaned "
    "FROM checked",
    "fk_self": self_check(),
    "fk_hierarchy": HIERARCHY,
    "pk_unique": """
      SELECT o_orderkey, count(*)::BIGINT AS rows FROM (
        SELECT CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderkey END AS o_orderkey FROM (
          SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderstatus = 'F'))
      GROUP BY 1 HAVING count(*) > 1 OR o_orderkey IS NULL""",
    "null_check": f"{faulty('lineitem')} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, (count(*) - count({c}))::BIGINT AS null_rows FROM d_lineitem"
        for c in STAR.tables["lineitem"].kinds
    ),
    "fk_mixed_keys": f"""{faulty('orders', 'customer')} SELECT form, measure,
      (SELECT count(*) FROM d_orders WHERE o_custkey IN (SELECT c_custkey FROM d_customer))::BIGINT AS n
      FROM (SELECT unnest(['decimal', 'double', 'padded']) AS form),
        (SELECT unnest(['valid', 'kept', 'kept_large']) AS measure)""",
    "fk_clean_self": """WITH RECURSIVE tree AS (
        SELECT p_partkey, CASE WHEN p_partkey > 5 THEN p_partkey // 3 END AS parent_key
        FROM part WHERE p_partkey % 7 <> 0
      ), alive AS (
        SELECT * FROM tree WHERE parent_key IS NULL
        UNION ALL SELECT t.* FROM tree t JOIN alive a ON t.parent_key = a.p_partkey
      ) SELECT p_partkey, parent_key FROM alive""",
    "csv_documents": "SELECT doc_id, text, lang, source, n_chars FROM documents",
    "fk_filter": f"{faulty('customer', 'orders')} SELECT * FROM d_orders "
    f"WHERE {matched(EDGES['orders.o_custkey'])}",
    "fk_clean_table": cleaned_lineitem(),
    "fk_clean_table_by_key": cleaned_lineitem(),
    "fk_clean_cascade": f"{cleaned()} SELECT * FROM c_lineitem",
    "fk_clean_cascade_by_key": f"{cleaned()} SELECT * FROM c_lineitem",
    "fk_clean_summary": f"{cleaned()} SELECT *, (rows_before - rows_after)::BIGINT AS rows_removed FROM ("
    + " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, (SELECT count(*) FROM d_{t})::BIGINT AS rows_before, "
        f"(SELECT count(*) FROM c_{t})::BIGINT AS rows_after"
        for t in STAR.tables
    )
    + ")",
    "table_stats": stats(),
    "table_stats_total": "SELECT sum(row_count)::BIGINT AS total_rows, "
    f"sum(column_count)::BIGINT AS total_columns FROM ({stats()})",
    "column_profile": profiled(),
    "column_profile_bounded": profiled_bounded(),
    "sample_rows": "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5",
    "row_count": "SELECT count(*)::BIGINT AS row_count FROM lineitem",
    "fk_report": f"{checked()} SELECT {ISSUES}, status, valid, total, valid_pct, orphaned FROM checked",
    "quality_score": f"{checked()}, sums AS (SELECT sum(total)::BIGINT AS t, sum(valid)::BIGINT AS v "
    "FROM checked) SELECT t AS total_references, v AS valid_references, (t - v)::BIGINT AS "
    f"invalid_references, {percent('v', 't')} AS valid_pct, "
    "CASE WHEN t = v THEN 'PERFECT' ELSE 'ISSUES' END AS verdict FROM sums",
    "fk_fan_in": f"{faulty()} " + " UNION ALL ".join(fan_in(e) for e in STAR.edges),
    "level_rollup": level_totals(),
    "union_counts": counts(STAR.tables),
    "total_records": f"SELECT sum(row_count)::BIGINT AS total_records FROM ({counts(STAR.tables)})",
    "distinct_keys": "SELECT DISTINCT o_custkey FROM orders",
    "sql_format_value": """
      SELECT c_custkey::VARCHAR AS key_sql,
        CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'NULL'
             WHEN c_mktsegment = 'HOUSEHOLD' THEN '''O''''' || c_name || ''''
             ELSE '''' || c_name || '''' END AS text_sql,
        CASE WHEN c_acctbal > 0 THEN c_acctbal::DECIMAL(19,2)::VARCHAR ELSE 'NULL' END AS money_sql,
        CASE WHEN c_acctbal > 5000 THEN '1' ELSE '0' END AS flag_sql,
        CASE WHEN c_acctbal > 0 THEN '1' ELSE '0' END AS word_sql
      FROM customer""",
    "sql_insert": f"SELECT {statements('orders', GIVEN_COLUMNS['orders'].split())} AS stmt FROM orders",
    "pool_build": f"WITH {pool_groups()} {pool_expanded('groups')}",
    "pool_select": f"""
      WITH {pool_groups()}, given AS (
        SELECT 'brands' AS pool, grp, row_number() OVER (PARTITION BY grp ORDER BY value) - 1 AS idx, value
        FROM {BRANDS} WHERE grp <> 'PROMO'),
      missing AS (SELECT * FROM groups WHERE NOT EXISTS (
        SELECT 1 FROM given WHERE given.pool = groups.pool AND given.grp = groups.grp))
      SELECT pool, grp, idx, value FROM given UNION ALL {pool_expanded('missing')}""",
    "pool_from_text": items(
        "names",
        500,
        f"(SELECT 'c' || c_custkey AS id, {REPLY} AS response FROM customer UNION ALL "
        "SELECT 't-' || conv_id || '-' || turn, text FROM conversations)",
        "id",
    ),
    "pool_from_documents": items(
        "names", 1_000_000, "(SELECT doc_id, text AS response FROM documents)", "doc_id"
    ),
}

assert ORACLES.keys() == QUERIES.keys()
