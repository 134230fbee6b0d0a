import json

import pytest

from tablewright import Catalog
from tablewright.catalog import integer, pk, ref, table
from tablewright.catalogs import SHOP, STAR

CONFIG = {
    "domain": "demo",
    "seed": 7,
    "output_format": "JSON",
    "tables": {
        "A": {
            "row_count": 3,
            "primary_key": "a_id",
            "columns": {
                "a_id": {"type": "pk"},
                "up": {"type": "fk", "ref_table": "A", "ref_column": "a_id", "null_ratio": 0.7},
                "name": {"type": "string"},
            },
            "_data_sources": {"name": "user_names"},
        },
        "B": {
            "row_count": 5,
            "primary_key": "b_id",
            "foreign_keys": {"a_id": {"ref_table": "A", "ref_column": "a_id"}},
            "columns": {"b_id": {"type": "pk"}, "n": {"type": "int", "min": 1, "max": 5}},
        },
    },
}


def test_json_declaration(tmp_path):
    path = tmp_path / "catalog.json"
    path.write_text(json.dumps(CONFIG))
    catalog = Catalog.from_json(str(path))
    assert (catalog.seed, catalog.output_format) == (7, "json")
    assert list(catalog.tables["B"].kinds.items()) == [("a_id", "fk"), ("b_id", "pk"), ("n", "int")]
    assert [e.column for e in catalog.edges] == ["a_id"]
    assert [e.column for e in catalog.nullable_edges] == ["up"]
    assert catalog.tables["A"].columns[2].pool == "user_names"


def test_unknown_format_and_parent_are_rejected():
    with pytest.raises(ValueError, match="output format"):
        Catalog.from_dict(CONFIG | {"output_format": "xml"})
    with pytest.raises(ValueError, match="no table"):
        Catalog.of("x", table("B", 1, ref("a_id", "A.a_id"), pk("b_id")))


def test_shop_totals():
    assert len(SHOP.tables) == 26
    assert sum(t.rows for t in SHOP.tables.values()) == 4_973_665
    assert len(SHOP.edges) == 32
    assert sum(len(t.kinds) for t in SHOP.tables.values()) == 198


def test_load_order_puts_parents_first():
    order = SHOP.load_order()
    for edge in SHOP.edges:
        assert order.index(edge.parent) < order.index(edge.child)


def test_cycle_is_placed_after_the_rest():
    catalog = Catalog.of(
        "cycle",
        table("P", 1, ref("q", "Q.q_id"), pk("p_id")),
        table("Q", 1, ref("p", "P.p_id"), pk("q_id")),
        table("R", 1, pk("r_id"), integer("n")),
    )
    assert catalog.load_order() == ["R", "P", "Q"]


def test_catalog_frames(spark):
    assert STAR.keys_frame(spark).count() == 9
    assert SHOP.columns_frame(spark).count() == 198
    levels = {r.table_name: r.load_level for r in SHOP.tables_frame(spark).collect()}
    assert levels["Users"] == 0 and levels["Finance_Refunds_Cost"] == 3
