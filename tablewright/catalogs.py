"""Declared catalogs that come with the package."""

from __future__ import annotations

from tablewright.catalog import (
    Catalog,
    boolean,
    decimal,
    email,
    enum,
    integer,
    nullable_ref,
    phone,
    pk,
    ref,
    string,
    table,
    timestamp,
    whole,
)


def _strings(names: str):
    return [string(name) for name in names.split()]


def _days(range_days: int, names: str):
    return [timestamp(name, range_days) for name in names.split()]


# The tables of an online shop with its finance records, their
# row counts, keys, column types and ranges.
SHOP = Catalog.of(
    "ecommerce",
    table(
        "Users", 100_000,
        pk("user_id"), string("name"), email("email"), phone("phone_number"),
        *_strings("password_hash address"),
        enum("city", "Bangalore", "Mumbai", "Delhi", "Hyderabad", "Chennai"),
        string("pincode"), timestamp("registration_date", 1500), timestamp("last_login", 30),
        boolean("is_active", 0.9), enum("user_type", "CUSTOMER", "ADMIN", "EMPLOYEE"),
        string("referral_code"),
    ),
    table(
        "Categories", 200,
        pk("category_id"), string("name"),
        nullable_ref("parent_category_id", "Categories.category_id", 0.7),
        *_strings("description image_url"),
    ),
    table(
        "Warehouses", 100,
        pk("warehouse_id"), *_strings("name address"),
        enum("city", "Bangalore", "Mumbai", "Delhi", "Hyderabad"),
        decimal("latitude", 8.0, 30.0), decimal("longitude", 70.0, 90.0),
        integer("capacity", 1000, 20000), boolean("is_active", 0.95),
    ),
    table(
        "Delivery_Partners", 3_000,
        pk("partner_id"), string("name"), phone("phone"),
        enum("vehicle_type", "BIKE", "CAR", "VAN"), string("current_location"),
        enum("availability_status", "AVAILABLE", "BUSY", "OFFLINE"),
        decimal("rating", 3.0, 5.0), timestamp("joined_date", 1200),
    ),
    table(
        "Products", 50_000,
        ref("category_id", "Categories.category_id"),
        pk("product_id"), *_strings("name description"),
        decimal("price", 50, 20000), decimal("discounted_price", 40, 18000),
        *_strings("brand sku"), decimal("weight", 0.1, 20.0), string("image_url"),
        boolean("is_available", 0.95), integer("stock_quantity", 0, 1000),
        timestamp("expiry_date", 900), string("tags"),
    ),
    table(
        "Carts", 80_000,
        ref("user_id", "Users.user_id"),
        pk("cart_id"), timestamp("created_date", 90), timestamp("last_updated", 7),
    ),
    table(
        "Cart_Items", 200_000,
        ref("cart_id", "Carts.cart_id"), ref("product_id", "Products.product_id"),
        pk("cart_item_id"), integer("quantity", 1, 5),
    ),
    table(
        "Inventory", 200_000,
        ref("product_id", "Products.product_id"), ref("warehouse_id", "Warehouses.warehouse_id"),
        pk("inventory_id"), integer("quantity_available", 0, 10000),
        integer("quantity_reserved", 0, 500), timestamp("last_updated", 3),
        integer("reorder_threshold", 50, 500),
    ),
    table(
        "Payments", 300_000,
        pk("payment_id"), decimal("amount", 100, 20000),
        enum("payment_method", "CARD", "UPI", "NETBANKING", "COD"), string("transaction_id"),
        enum("status", "SUCCESS", "FAILED", "PENDING"), timestamp("payment_date", 365),
    ),
    table(
        "Orders", 300_000,
        ref("user_id", "Users.user_id"), ref("partner_id", "Delivery_Partners.partner_id"),
        ref("payment_id", "Payments.payment_id"),
        pk("order_id"), timestamp("order_date", 365),
        enum("status", "PLACED", "SHIPPED", "DELIVERED", "CANCELLED"),
        decimal("total_amount", 100, 20000), decimal("discount_applied", 0, 2000),
    ),
    table(
        "Order_Items", 900_000,
        ref("order_id", "Orders.order_id"), ref("product_id", "Products.product_id"),
        pk("order_item_id"), integer("quantity", 1, 5), decimal("unit_price", 50, 20000),
        decimal("subtotal", 50, 50000), boolean("is_substituted", 0.05),
    ),
    table(
        "Refunds", 50_000,
        ref("order_id", "Orders.order_id"), ref("payment_id", "Payments.payment_id"),
        pk("refund_id"), decimal("refund_amount", 50, 20000), string("refund_reason"),
        enum("refund_status", "INITIATED", "COMPLETED", "REJECTED"),
        enum("refund_method", "ORIGINAL", "WALLET"), timestamp("refund_date", 365),
    ),
    table(
        "Deliveries", 300_000,
        ref("order_id", "Orders.order_id"), ref("partner_id", "Delivery_Partners.partner_id"),
        pk("delivery_id"), *_days(365, "assigned_time pickup_time delivery_time"),
        enum("status", "ASSIGNED", "IN_TRANSIT", "DELIVERED"), string("route_details"),
    ),
    table(
        "Promotions", 20_000,
        ref("user_id", "Users.user_id"), ref("product_id", "Products.product_id"),
        pk("promo_id"), string("code"), enum("type", "FLAT", "PERCENT"),
        decimal("discount_value", 50, 500), *_days(365, "start_date end_date"),
    ),
    table(
        "Reviews", 150_000,
        ref("product_id", "Products.product_id"), ref("user_id", "Users.user_id"),
        ref("order_id", "Orders.order_id"),
        pk("review_id"), integer("rating", 1, 5), string("comment"),
        timestamp("review_date", 365), boolean("is_verified", 0.85),
    ),
    table(
        "Search_Logs", 500_000,
        ref("user_id", "Users.user_id"),
        pk("log_id"), string("search_query"), timestamp("timestamp", 30),
        integer("results_count", 0, 500),
    ),
    table(
        "App_Usage_Logs", 800_000,
        ref("user_id", "Users.user_id"),
        pk("log_id"), *_strings("session_id page_viewed"), integer("time_spent", 1, 600),
        enum("device_type", "ANDROID", "IOS", "WEB"), timestamp("timestamp", 30),
    ),
    table(
        "Subscriptions", 40_000,
        ref("user_id", "Users.user_id"),
        pk("sub_id"), enum("plan_type", "BASIC", "PREMIUM"),
        *_days(365, "start_date end_date"), enum("status", "ACTIVE", "EXPIRED"),
    ),
    table(
        "Finance_Operational_Expenses", 10_000,
        pk("expense_id"), enum("expense_type", "INFRA", "MARKETING", "OPS"),
        string("expense_category"), decimal("expense_amount", 1000, 500000),
        timestamp("expense_date", 365), string("remarks"),
    ),
    table(
        "Finance_Orders_Revenue", 300_000,
        ref("order_id", "Orders.order_id"),
        pk("revenue_id"), decimal("gross_order_amount", 100, 20000),
        decimal("discount_amount", 0, 5000), decimal("net_order_amount", 50, 20000),
        decimal("promo_cost", 0, 2000), timestamp("revenue_date", 365),
    ),
    table(
        "Finance_Payments_Settlement", 300_000,
        ref("order_id", "Orders.order_id"), ref("payment_id", "Payments.payment_id"),
        pk("settlement_id"), decimal("payment_gateway_fee", 10, 1000),
        decimal("platform_commission", 50, 2000), decimal("net_settlement_amount", 50, 20000),
        timestamp("settlement_date", 365),
    ),
    table(
        "Finance_Refunds_Cost", 50_000,
        ref("refund_id", "Refunds.refund_id"), ref("order_id", "Orders.order_id"),
        pk("refund_cost_id"), decimal("refund_amount", 50, 20000),
        decimal("refund_processing_fee", 10, 500), decimal("refund_loss_amount", 0, 2000),
        timestamp("refund_date", 365),
    ),
    table(
        "Finance_Delivery_Costs", 300_000,
        ref("order_id", "Orders.order_id"), ref("partner_id", "Delivery_Partners.partner_id"),
        pk("delivery_cost_id"), decimal("base_delivery_fee", 50, 500), decimal("surge_fee", 0, 200),
        decimal("tips_paid", 0, 500), decimal("total_delivery_cost", 50, 1000),
        timestamp("cost_date", 365),
    ),
    table(
        "Finance_Partner_Payouts", 10_000,
        ref("partner_id", "Delivery_Partners.partner_id"),
        pk("payout_id"), integer("total_orders_delivered", 1, 500),
        decimal("total_delivery_earnings", 1000, 100000), decimal("incentive_amount", 0, 10000),
        decimal("penalty_amount", 0, 5000), decimal("net_payout_amount", 500, 100000),
        *_days(365, "payout_period_start payout_period_end payout_date"),
    ),
    table(
        "Finance_Employee_Salary", 10_000,
        ref("user_id", "Users.user_id"),
        pk("salary_id"), string("role"), decimal("base_salary", 20000, 500000),
        decimal("bonus", 0, 100000), decimal("deductions", 0, 50000),
        decimal("net_salary", 15000, 500000), *_days(365, "salary_month payment_date"),
    ),
    table(
        "Finance_Profit_Loss_Summary", 365,
        pk("pl_id"), *_days(365, "period_start_date period_end_date"),
        decimal("total_revenue", 100000, 5000000), decimal("total_refunds", 0, 500000),
        decimal("total_delivery_cost", 50000, 1000000),
        decimal("total_salary_cost", 100000, 2000000),
        decimal("total_operational_cost", 50000, 1500000),
        decimal("net_profit_loss", -1000000, 2000000), timestamp("calculated_date", 365),
    ),
    single_line_text=True,
)

# The given star tables and the references that hold among them.  Row counts
# are read from the data, not declared.
STAR = Catalog.of(
    "star",
    table("region", 0, pk("r_regionkey"), string("r_name")),
    table("nation", 0, ref("n_regionkey", "region.r_regionkey"), pk("n_nationkey"), string("n_name")),
    table(
        "customer", 0,
        ref("c_nationkey", "nation.n_nationkey"),
        pk("c_custkey"), string("c_name"), decimal("c_acctbal"), string("c_mktsegment"),
    ),
    table(
        "supplier", 0,
        ref("s_nationkey", "nation.n_nationkey"),
        pk("s_suppkey"), string("s_name"), decimal("s_acctbal"),
    ),
    table(
        "part", 0,
        pk("p_partkey"), string("p_name"), string("p_brand"), string("p_type"),
        integer("p_size"), decimal("p_retailprice"),
    ),
    table(
        "orders", 0,
        ref("o_custkey", "customer.c_custkey"),
        pk("o_orderkey"), string("o_orderstatus"), decimal("o_totalprice"),
        timestamp("o_orderdate"), string("o_orderpriority"),
    ),
    table(
        "lineitem", 0,
        ref("l_orderkey", "orders.o_orderkey"), ref("l_partkey", "part.p_partkey"),
        ref("l_suppkey", "supplier.s_suppkey"),
        integer("l_linenumber"), decimal("l_quantity"), decimal("l_extendedprice"),
        decimal("l_discount"), decimal("l_tax"), string("l_returnflag"), string("l_linestatus"),
        timestamp("l_shipdate"),
    ),
    table(
        "documents", 0,
        pk("doc_id"), string("text"), string("lang"), string("source"), whole("n_chars"),
    ),
    table("pages", 0, pk("page_id"), string("url"), string("html")),
    table("benchmark", 0, pk("item_id"), string("text")),
    table("conversations", 0, whole("conv_id"), whole("turn"), string("role"), string("text")),
    table("labels", 0, ref("doc_id", "documents.doc_id"), integer("quality"), integer("toxic")),
    table(
        "events", 0,
        ref("user_id", "customer.c_custkey"),
        pk("event_id"), timestamp("ts"), string("event_type"), decimal("value"), string("props"),
    ),
    output_format="parquet",
)
