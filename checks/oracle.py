"""DuckDB SQL for the queries, written apart from the Spark code.

Each entry is a final SELECT over named views; a query gets the views it needs, directly or
through others, as common table expressions. Doubles are rounded to six places after adding 1e-9,
here and in the queries, so that halves, which engines round differently, go the same way.
"""

from __future__ import annotations

import re

from grapevine.sources.schemas import CATEGORY_FLAGS

AS_OF = "DATE '2001-08-10'"
_CATEGORIES = ", ".join(f"({n}, {i}, '{name}')" for n, (i, name) in enumerate(CATEGORY_FLAGS.items()))

# --- shop tables out of the test tables -----------------------------------------------------

VIEWS: dict[str, str] = {
    "v_shop_customer": """
        SELECT c_custkey AS id,
               CASE WHEN c_custkey % 50 = 7 THEN 'user' || c_custkey
                    ELSE '55' || lpad(c_custkey::VARCHAR, 8, '0') END AS username,
               CASE WHEN c_custkey = 11 THEN 'CLUB-10'
                    ELSE upper(c_mktsegment[1:4]) || '-' || c_custkey END AS own_code,
               DATE '1995-01-01' + (c_custkey * 37 % 2400)::INTEGER AS born
        FROM customer""",
    "v_shop_address": """
        SELECT id, '55' || lpad(id::VARCHAR, 8, '0') AS phone, p_name AS firstname
        FROM (SELECT c_custkey AS id, c_custkey % (SELECT count(*) FROM part) AS part_key FROM customer)
        JOIN part ON p_partkey = part_key""",
    "v_shop_order": """
        SELECT o_orderkey AS id, o_custkey AS customer_id,
               (o_orderkey * 7 + o_custkey) % (SELECT count(*) FROM supplier) AS store_id,
               o_orderdate + to_seconds(o_orderkey * 7919 % 86400) AS placed,
               o_orderdate + to_seconds(o_orderkey * 7919 % 86400) - INTERVAL 6 HOUR AS placed_local,
               o_totalprice AS total
        FROM orders""",
    "v_shop_usage": """
        SELECT o_orderkey AS order_id, used_at,
               CASE WHEN o_orderkey % 40 = 0 THEN -1
                    WHEN o_orderkey % 44 = 0 THEN -2
                    ELSE r * r * r // (n * n) END AS discount_id
        FROM (SELECT o_orderkey, n, o_orderkey * 31 % n AS r,
                     o_orderdate + to_seconds(o_orderkey * 7919 % 86400) AS used_at
              FROM orders, (SELECT count(*) AS n FROM customer))""",
    "v_shop_discount": """
        SELECT id, CASE WHEN id % 2 = 1 THEN lower(own_code) ELSE own_code END AS code
        FROM v_shop_customer WHERE id <> 11
        UNION ALL VALUES (-1, 'CLUB-10'), (-2, 'PROMO')""",
    "v_shop_store": """
        SELECT s_suppkey AS id, s_name AS name, s_nationkey,
               CASE WHEN s_suppkey % 10 <> 0 THEN (1000 + s_nationkey)::VARCHAR END AS zip,
               19 + (s_suppkey % 100) / 100.0::DOUBLE AS lat,
               -99 - s_nationkey / 100.0::DOUBLE AS lon
        FROM supplier""",
    "v_shop_product_category": f"""
        SELECT p_partkey AS product_id, id AS category_id, name AS category
        FROM part
        JOIN (VALUES {_CATEGORIES}) AS c(number, id, name)
          ON number = p_partkey % 20 OR (p_partkey % 11 = 0 AND number = (p_partkey + 7) % 20)
        WHERE p_partkey % 13 <> 0""",
    # --- redemptions --------------------------------------------------------------------------
    "v_personal_code": """
        SELECT id, code FROM v_shop_discount WHERE code ILIKE '%-%' AND code NOT ILIKE 'CLUB%'""",
    "v_order_novelty": """
        SELECT o.id AS order_id,
               CASE WHEN strftime(c.born, '%y%j') < strftime(o.placed_local, '%y%j')
                    THEN 'OLD' ELSE 'NEW CUSTOMER' END AS novelty,
               strftime(o.placed_local, '%y%V') AS week
        FROM v_shop_order o, v_shop_customer c WHERE c.id = o.customer_id""",
    "v_redeemed": """
        SELECT u.order_id, u.used_at, p.code, h.id AS client, h.username AS giver, ha.firstname AS giver_name,
               t.firstname AS taker_name, t.phone AS taker, o.customer_id AS child, o.total, n.week, n.novelty,
               s.name AS store, s.id AS store_id, s.zip
        FROM v_personal_code p
        JOIN v_shop_customer h ON upper(p.code) = upper(h.own_code)
        JOIN v_shop_address ha ON ha.id = h.id
        JOIN v_shop_usage u ON u.discount_id = p.id
        JOIN v_shop_order o ON o.id = u.order_id
        JOIN v_shop_address t ON t.id = o.customer_id
        JOIN v_order_novelty n ON n.order_id = o.id
        JOIN v_shop_store s ON s.id = o.store_id""",
    # --- interactions and users ---------------------------------------------------------------
    "v_pair_row": """
        SELECT *, count(*) OVER (PARTITION BY giver, taker) AS n,
               row_number() OVER (PARTITION BY giver, taker
                                  ORDER BY used_at DESC NULLS FIRST, total, order_id, client) AS newest
        FROM v_redeemed""",
    "v_edge": """
        SELECT order_id, used_at, code, client, giver, giver_name, taker_name, taker, child,
               'w-' || week::BIGINT AS week, CASE WHEN n > 1 THEN 'OLD' ELSE novelty END AS novelty,
               store, store_id, zip, n,
               CASE WHEN zip IS NULL THEN 'zc-nan' ELSE 'zc-' || zip END AS zip_code,
               'SId-' || store_id AS store_key
        FROM v_pair_row WHERE newest = 1""",
    "v_node": """
        WITH seen AS (SELECT giver AS phone, giver_name AS name, 1 AS gives, total, order_id FROM v_redeemed
                      UNION ALL SELECT taker, taker_name, 0, total, order_id FROM v_redeemed),
             numbered AS (SELECT *, sum(gives) OVER (PARTITION BY phone) AS n_shares,
                                 row_number() OVER (PARTITION BY phone
                                                    ORDER BY gives DESC, total NULLS FIRST, order_id) AS rn
                          FROM seen)
        SELECT phone, name, n_shares::BIGINT AS n_shares,
               CASE WHEN n_shares > 0 THEN 'Intermediate user' ELSE 'End user' END AS user_type
        FROM numbered WHERE rn = 1""",
    "v_giver_client": """
        SELECT DISTINCT ON (giver) giver AS phone, client FROM v_edge
        ORDER BY giver, n, used_at NULLS FIRST, order_id""",
    "v_taker_client": """
        SELECT DISTINCT ON (taker) taker AS phone, child FROM v_edge
        ORDER BY taker, n, used_at NULLS FIRST, order_id""",
    "v_threshold": "SELECT avg(n_shares) AS mean_shares FROM v_node WHERE n_shares <> 0",
    "v_person": """
        SELECT v_node.*, CASE WHEN n_shares <> 0 THEN g.client ELSE t.child END AS client,
               CASE WHEN n_shares = 0 THEN 'passive'
                    WHEN n_shares > (SELECT mean_shares FROM v_threshold) THEN 'influencer'
                    ELSE 'intermediate' END AS stage
        FROM v_node LEFT JOIN v_giver_client g USING (phone) LEFT JOIN v_taker_client t USING (phone)""",
    "v_inf_edge": """
        SELECT * FROM v_edge WHERE client IN (SELECT client FROM v_person WHERE stage = 'influencer')""",
    # --- reach --------------------------------------------------------------------------------
    "v_zip_of": "SELECT DISTINCT client, zip FROM v_inf_edge",
    "v_store_of": "SELECT DISTINCT client, store FROM v_inf_edge",
    "v_week_of": "SELECT DISTINCT client, substr(week, 3) AS week FROM v_inf_edge",
    "v_counted": """
        SELECT e.client, e.n AS n_users, e.coupon,
               (SELECT count(*) FROM v_zip_of z WHERE z.client = e.client) AS n_zips,
               (SELECT count(*) FROM v_store_of s WHERE s.client = e.client) AS n_stores,
               (SELECT count(*) FROM v_week_of w WHERE w.client = e.client) AS n_weeks
        FROM (SELECT client, count(*) AS n, any_value(code) AS coupon FROM v_inf_edge GROUP BY client) e""",
    "v_scaled": """
        SELECT *,
               (n_users - min(n_users) OVER ()) / nullif(max(n_users) OVER () - min(n_users) OVER (), 0)::DOUBLE
                   AS vir_users,
               (places - min(places) OVER ()) / nullif(max(places) OVER () - min(places) OVER (), 0)
                   AS vir_physical,
               (n_weeks - min(n_weeks) OVER ()) / nullif(max(n_weeks) OVER () - min(n_weeks) OVER (), 0)::DOUBLE
                   AS vir_temp
        FROM (SELECT *, 1.0::DOUBLE * n_zips + 0.8::DOUBLE * n_stores AS places FROM v_counted)""",
    # --- growth -------------------------------------------------------------------------------
    "v_use_point": """
        SELECT client, day, n, date_diff('day', first_day, day) AS x, y, arg_min(n, day) OVER (PARTITION BY client) AS u0
        FROM (SELECT client, day, n, min(day) OVER (PARTITION BY client) AS first_day,
                     sum(n) OVER (PARTITION BY client ORDER BY day) AS y
              FROM (SELECT client, used_at::DATE AS day, count(*) AS n FROM v_inf_edge GROUP BY ALL))""",
    "v_event_point": """
        SELECT client, day, n, date_diff('day', first_day, day) AS x, y, arg_min(n, day) OVER (PARTITION BY client) AS u0
        FROM (SELECT client, day, n, min(day) OVER (PARTITION BY client) AS first_day,
                     sum(n) OVER (PARTITION BY client ORDER BY day) AS y
              FROM (SELECT user_id % 15 AS client, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL))""",
    # --- behaviour ----------------------------------------------------------------------------
    "v_arrival": """
        SELECT *, date_trunc('week', fecha)::DATE AS monday
        FROM (SELECT id AS order_id, customer_id, store_id, soon + (dayofweek(soon) = 0)::INTEGER AS fecha
              FROM (SELECT *, placed_local::DATE + 1 + (placed_local::TIME > TIME '21:00:00')::INTEGER AS soon
                    FROM v_shop_order))""",
    "v_calendar": """
        SELECT fecha, monday,
               (date_trunc('week', make_date(year(monday), 1, 4))
                + to_days((7 * ((dayofyear(monday) - 1) // 7))::INTEGER))::DATE AS semana
        FROM (SELECT DISTINCT fecha, monday FROM v_arrival)""",
    "v_line": """
        SELECT a.customer_id AS cliente, s.id AS tienda, s.zip, s.lat, s.lon, 'SKU-' || l_partkey AS sku,
               CASE WHEN l_orderkey % 97 = 0 THEN 0 ELSE l_extendedprice::DECIMAL(18, 4) END AS price,
               l_quantity::INTEGER * (6 * p_retailprice::DECIMAL(18, 2) / 10)::DECIMAL(18, 4) AS cost,
               g.category, g.category_id, a.fecha, k.semana
        FROM lineitem
        JOIN v_arrival a ON a.order_id = l_orderkey
        JOIN v_calendar k ON k.fecha = a.fecha
        JOIN v_shop_customer c ON c.id = a.customer_id
        JOIN v_shop_store s ON s.id = a.store_id
        JOIN part ON p_partkey = l_partkey
        JOIN v_shop_product_category g ON g.product_id = l_partkey""",
    "v_lifetime": """
        SELECT cliente, min(semana) AS born, max(semana) AS last, count(DISTINCT sku) AS skus,
               count(DISTINCT category) AS cats
        FROM v_line GROUP BY cliente""",
    "v_store_week_client": """
        SELECT semana, tienda, cliente, any_value(zip) AS zip, sum(price) AS gmv, sum(cost) AS cost,
               count(DISTINCT sku) AS skus, count(DISTINCT category) AS cats,
               (sum(price) - sum(cost))::DOUBLE / nullif(sum(price), 0)::DOUBLE AS gm
        FROM v_line GROUP BY semana, tienda, cliente""",
    "v_order_day": """
        SELECT fecha, any_value(semana) AS semana, cliente, (sum(price) > 0)::BIGINT AS pedido
        FROM v_line GROUP BY fecha, cliente""",
    "v_order_days": "SELECT semana, cliente, sum(pedido)::BIGINT AS n FROM v_order_day GROUP BY semana, cliente",
    "v_store_week": """
        SELECT semana, tienda, any_value(zip) AS zip, any_value(lat) AS lat, any_value(lon) AS lon,
               count(DISTINCT cliente) AS clients
        FROM v_line GROUP BY semana, tienda""",
    "v_activity": f"""
        SELECT cliente, CASE WHEN {AS_OF} - last < 15 THEN 1 ELSE 0 END::BIGINT AS active FROM v_lifetime""",
    "v_behaved": """
        SELECT w.semana, l.born, l.last, a.active, w.cliente, w.tienda, w.zip, w.gmv, d.n AS freq, s.clients,
               s.lat, s.lon, w.skus, w.cats, w.cost, w.gm, l.skus AS all_skus, l.cats AS all_cats,
               w.gmv::DOUBLE / nullif(d.n, 0) AS aov
        FROM (SELECT *, row_number() OVER (PARTITION BY semana, cliente ORDER BY tienda) AS rn
              FROM v_store_week_client) w
        JOIN v_lifetime l USING (cliente)
        JOIN v_activity a USING (cliente)
        JOIN v_order_days d USING (semana, cliente)
        JOIN v_store_week s USING (semana, tienda)
        WHERE rn = 1""",
    "v_main_category": """
        SELECT 'SKU-' || product_id AS sku, min(category_id) AS category_id FROM v_shop_product_category GROUP BY 1""",
    "v_paid_once": """
        SELECT semana, tienda, cliente, sum(price) AS gmv, sum(cost) AS cost
        FROM v_line JOIN v_main_category USING (sku, category_id) GROUP BY ALL""",
    "v_paid_day": """
        SELECT semana, cliente, count(*) FILTER (WHERE paid > 0) AS n
        FROM (SELECT fecha, semana, cliente, sum(price) AS paid
              FROM v_line JOIN v_main_category USING (sku, category_id) GROUP BY ALL)
        GROUP BY ALL""",
    "v_behaved_once": """
        SELECT b.* EXCLUDE (gmv, cost, freq, gm, aov), p.gmv, p.cost, d.n AS freq,
               (p.gmv - p.cost)::DOUBLE / nullif(p.gmv, 0)::DOUBLE AS gm, p.gmv::DOUBLE / nullif(d.n, 0) AS aov
        FROM v_behaved b JOIN v_paid_once p USING (semana, tienda, cliente) JOIN v_paid_day d USING (semana, cliente)""",
    "v_client_mean": """
        SELECT cliente AS client, avg(active) AS active, avg(freq) AS freq, avg(gmv) AS gmv, avg(aov::DECIMAL(28, 8)) AS aov
        FROM v_behaved GROUP BY cliente""",
    # --- invited customers --------------------------------------------------------------------
    "v_own_use": "SELECT client, max(CASE WHEN giver = taker THEN 1 ELSE 0 END)::BIGINT AS self FROM v_inf_edge GROUP BY client",
    "v_hop": """
        SELECT p.client, any_value(self) AS self, count(DISTINCT p.taker) - any_value(self) AS n_children,
               count(DISTINCT e.client) - any_value(self) AS n_sharing
        FROM v_inf_edge p JOIN v_own_use USING (client) LEFT JOIN v_edge e ON e.giver = p.taker
        GROUP BY p.client""",
    "v_sharing": """
        SELECT client, n_children, n_sharing,
               round_even(n_sharing * 100 / nullif(n_children, 0)::DOUBLE, 2) / 100 AS rate
        FROM v_hop""",
    "v_child_pair": """
        SELECT DISTINCT client, child FROM v_inf_edge JOIN v_own_use USING (client)
        WHERE NOT (self = 1 AND child = client)""",
    "v_child_mean": """
        SELECT c.client AS parent, c.child, m.active, m.freq, m.gmv, m.aov
        FROM v_child_pair c JOIN v_client_mean m ON m.client = c.child""",
    "v_child_active": "SELECT parent AS client, avg(active) AS fraction FROM v_child_mean GROUP BY parent",
    "v_parent_metric": """
        SELECT o.client, m.active, m.freq, m.gmv, m.aov, s.rate, f.fraction
        FROM v_own_use o LEFT JOIN v_client_mean m USING (client) LEFT JOIN v_sharing s USING (client)
             LEFT JOIN v_child_active f USING (client)""",
    # --- results ------------------------------------------------------------------------------
    "v_scored": """
        SELECT v_person.*, m.active, m.freq, m.gmv, m.aov, v.n_users, v.coupon, v.n_zips, v.n_stores, v.n_weeks,
               v.vir_users, v.vir_physical, v.vir_temp, s.rate, f.fraction, k.k AS k_factor,
               n_shares / nullif(v.n_users, 0)::DOUBLE AS per_user,
               m.active + vir_users + vir_physical + vir_temp + rate + fraction AS score
        FROM v_person
        LEFT JOIN v_client_mean m USING (client)
        LEFT JOIN v_scaled v ON v.client = v_person.client AND stage = 'influencer'
        LEFT JOIN v_sharing s ON s.client = v.client
        LEFT JOIN v_child_active f ON f.client = v.client
        LEFT JOIN v_use_fit k ON k.client = v.client""",
    "v_final_stage": """
        SELECT *, row_number() OVER (PARTITION BY stage
                                     ORDER BY CASE WHEN stage = 'influencer' THEN score ELSE aov END DESC NULLS LAST,
                                              phone) AS stage_rank
        FROM v_scored""",
    "v_final_edge": """
        SELECT v_edge.*, stage FROM v_edge JOIN v_person USING (client) WHERE stage <> 'passive'""",
    # --- forecasts ----------------------------------------------------------------------------
    "v_forecast": """
        SELECT event_id, event_type, CASE WHEN event_id % 20 = 0 THEN 0 ELSE floor(value) END AS t, value + event_id % 3 AS p
        FROM events""",
}


def _fit(points: str, prefix: str) -> dict[str, str]:
    """Views for the least-squares k: a grid in steps of 0.01, then two finer grids around the best."""
    error = f"""
        SELECT client, k, sum((CASE WHEN k = 1 THEN u0 * x ELSE u0 * (pow(k, x) - 1) / (k - 1) END - y) ** 2) AS error
        FROM (SELECT p.client, p.x::DOUBLE AS x, p.y::DOUBLE AS y, p.u0::DOUBLE AS u0, g.k
              FROM {points} p JOIN v_{prefix}_grid%d g USING (client))
        GROUP BY client, k"""
    best = "SELECT client, arg_min(k, (error, k)) AS k FROM ({}) GROUP BY client"
    finer = "SELECT client, k + i * {} AS k FROM {}, generate_series(-100, 100) AS s(i) WHERE k + i * {} BETWEEN 0.01 AND 10"
    return {
        f"v_{prefix}_grid1": f"""
            SELECT client, i / 100.0::DOUBLE AS k
            FROM (SELECT client FROM {points} GROUP BY client HAVING count(*) >= 5), generate_series(1, 1000) AS s(i)""",
        f"v_{prefix}_best1": best.format(error % 1),
        f"v_{prefix}_grid2": finer.format("1e-4", f"v_{prefix}_best1", "1e-4"),
        f"v_{prefix}_best2": best.format(error % 2),
        f"v_{prefix}_grid3": finer.format("1e-6", f"v_{prefix}_best2", "1e-6"),
        f"v_{prefix}_best3": best.format(error % 3),
        f"v_{prefix}_fit": f"""
            SELECT client, b.k FROM (SELECT DISTINCT client FROM {points}) LEFT JOIN v_{prefix}_best3 b USING (client)""",
    }


VIEWS |= _fit("v_use_point", "use") | _fit("v_event_point", "event")


def _with(select: str) -> str:
    """Put the views a SELECT needs in front of it, each after those it reads."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bv_\w+", text):
            if name not in needed:
                visit(VIEWS[name])
                needed.append(name)

    visit(select)
    views = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in needed)
    return f"WITH {views}\n{select}"


REDEMPTION = """order_id AS "OrderId", used_at::VARCHAR AS "OrderUTC", code AS "CouponCode", client AS "ClientId" """
EDGE = REDEMPTION + """, giver AS "from", giver_name AS "Referrer_Name", taker_name AS "Referral_Name",
    taker AS "to", child AS "childId", week, novelty AS "IsNewCustomer", store AS "StoreName",
    store_id AS "StoreId", zip AS "ZipCode", n AS n_interactions, zip_code, store_key"""
NODE = """phone AS id, name AS label, user_type, n_shares"""
MEANS = """round(active + 1e-9, 6) AS active, round(freq + 1e-9, 6) AS mean_freq, round(gmv + 1e-9, 6) AS mean_gmv"""
FINAL_STAGE = f"""phone AS phone_number, name AS user_name, n_shares, client AS client_id,
    n_users AS n_distinct_users, round(per_user + 1e-9, 6) AS mean_shares_per_user, round(vir_users + 1e-9, 6) AS vir_users,
    coupon, n_zips AS delivery_zipcodes, n_stores AS delivery_stores, round(vir_physical + 1e-9, 6) AS vir_physical,
    n_weeks AS n_active_weeks, round(vir_temp + 1e-9, 6) AS vir_temp, round(k_factor + 5e-7, 3) AS k_factor,
    {MEANS}, round(aov + 1e-9, 6) AS mean_aov, round(rate + 1e-9, 6) AS child_sharing_rate,
    round(fraction + 1e-9, 6) AS active_child_fracc, round(score + 1e-9, 6) AS virality_score, stage AS user_type, stage_rank"""
SHORT_STAGE = f"""phone AS phone_number, name AS user_name, n_shares, client AS client_id, {MEANS},
    round(aov + 1e-9, 6) AS mean_aov, stage AS user_type, stage_rank"""
FINAL_EDGE = """order_id, used_at::VARCHAR AS order_utc, code AS coupon_code, client AS referrer_client_id,
    giver AS referrer_phone_number, giver_name AS referrer_name, taker_name AS referral_name,
    taker AS referral_phone_number, child AS referral_client_id, week, novelty AS is_new_customer,
    store AS store_name, store_id, zip AS zipcode, n AS n_interactions, zip_code, store_key,
    stage AS referrer_type"""
FLAGS = ", ".join(
    f"(CASE WHEN sum(price) FILTER (category_id = {i}) > 0 THEN 1 "
    f"WHEN count(*) FILTER (category_id = {i}) > 0 THEN 0 END)::BIGINT AS {name}"
    for i, name in CATEGORY_FLAGS.items()
)

SELECTS: dict[str, str] = {
    "redemptions": f"""SELECT {REDEMPTION}, giver AS "Referrer_num", giver_name AS "Referrer_Name",
        taker_name AS "Referral_Name", taker AS "Referral_num", child AS "childId",
        round(total + 1e-9, 6) AS "GMV_after_discount", week, novelty AS "IsNewCustomer", store AS "StoreName",
        store_id AS "StoreId", zip AS "ZipCode" FROM v_redeemed ORDER BY order_id, client""",
    "personal_coupons": """SELECT id AS "Id", code AS "CouponCode" FROM v_personal_code""",
    "referrer_of_coupon": """SELECT p.id AS "DiscountId", code AS "CouponCode", h.id AS "ClientId",
        username AS "Referrer_num", h.id AS "BillingAddress_Id"
        FROM v_personal_code p JOIN v_shop_customer h ON upper(code) = upper(own_code)""",
    "buyer_coupon_orders": """SELECT u.order_id AS "OrderId", u.used_at::VARCHAR AS "OrderUTC",
        p.code AS "CouponCode", b.id AS "ClientId", b.username AS "Referrer_num", a.firstname AS "Referrer_Name",
        a.firstname AS "Referral_Name", a.phone AS "Referral_num", round(o.total + 1e-9, 6) AS "GMV_after_discount",
        n.week, n.novelty AS "IsNewCustomer", s.name AS "StoreName", s.id AS "StoreId", s.zip AS "ZipCode"
        FROM v_personal_code p
        JOIN v_shop_usage u ON u.discount_id = p.id
        JOIN v_shop_order o ON o.id = u.order_id
        JOIN v_shop_customer b ON b.id = o.customer_id
        JOIN v_shop_address a ON a.id = b.id
        JOIN v_shop_store s ON s.id = o.store_id
        JOIN v_order_novelty n ON n.order_id = o.id""",
    "customer_zip": """SELECT c_custkey AS "AddressId", phone AS "PhoneNumber", c_custkey AS "UserId",
        c_custkey AS "BillingAddress_Id", c_custkey AS "EntityId", (1000 + c_nationkey)::VARCHAR AS "ZipCode"
        FROM customer JOIN v_shop_address ON id = c_custkey""",
    "split_identities": """SELECT c.id AS "ClientId", username AS own_number, phone AS billing_number
        FROM v_shop_customer c JOIN v_shop_address a ON a.id = c.id WHERE username IS DISTINCT FROM phone""",
    "new_customer_flag": """SELECT order_id AS "OrderId", child AS "childId", novelty AS "IsNewCustomer"
        FROM v_redeemed ORDER BY order_id, client""",
    "local_time": """SELECT id AS "Id", placed_local::VARCHAR AS local_time FROM v_shop_order""",
    "week_code": """SELECT id AS "Id", strftime(placed_local, '%y%V') AS week FROM v_shop_order""",
    "zip_label": """SELECT order_id AS "OrderId", client AS "ClientId", zip AS "ZipCode",
        'zc-' || coalesce(zip, 'nan') AS zip_code FROM v_redeemed ORDER BY order_id, client""",
    "store_label": """SELECT order_id AS "OrderId", client AS "ClientId", store_id AS "StoreId",
        format('SId-{}', store_id) AS store_key FROM v_redeemed ORDER BY order_id, client""",
    "week_label": """SELECT order_id AS "OrderId", client AS "ClientId", week,
        'w-' || (CASE WHEN week[1] <> '0' THEN week WHEN week[1:3] = '000' THEN week[4:] WHEN week[1:2] = '00' THEN week[3:]
                      ELSE week[2:] END) AS week_tag FROM v_redeemed ORDER BY order_id, client""",
    "pair_counts": """SELECT giver AS "from", taker AS "to", count(*) AS n_interactions FROM v_redeemed GROUP BY ALL""",
    "repeat_pairs": """SELECT giver AS "from", taker AS "to", count(*) AS n_interactions FROM v_redeemed
        GROUP BY ALL HAVING count(*) > 1""",
    "share_counts": """SELECT giver AS "from", count(*) AS n_shares FROM v_redeemed
        WHERE giver IS NOT NULL GROUP BY giver""",
    "latest_interaction": """SELECT giver AS "from", taker AS "to", order_id AS "OrderId",
        used_at::VARCHAR AS "OrderUTC", n AS n_interactions FROM v_pair_row WHERE newest = 1""",
    "interactions": f"SELECT {EDGE} FROM v_edge",
    "users": f"SELECT {NODE} FROM v_node",
    "csv_interactions": f"SELECT {EDGE} FROM v_edge",
    "csv_users": f"SELECT {NODE} FROM v_node",
    "user_client_id": """SELECT phone AS id, g.client AS "ClientId" FROM v_node LEFT JOIN v_giver_client g USING (phone)""",
    "non_sharer_client_id": """SELECT phone AS id, client AS "ClientId" FROM v_person WHERE n_shares = 0""",
    "share_threshold": "SELECT round(mean_shares + 1e-9, 6) AS mean_shares FROM v_threshold",
    "sharers": f"""SELECT {NODE}, client AS "ClientId" FROM v_person WHERE n_shares > 0""",
    "non_sharers": f"""SELECT {NODE}, client AS "ClientId" FROM v_person WHERE n_shares = 0""",
    "influencers": f"""SELECT {NODE}, client AS "ClientId" FROM v_person WHERE stage = 'influencer'""",
    "intermediates": f"""SELECT {NODE}, client AS "ClientId" FROM v_person WHERE stage = 'intermediate'""",
    "influencer_interactions": f"SELECT {EDGE} FROM v_inf_edge",
    "intermediate_interactions": f"SELECT {EDGE} FROM v_final_edge WHERE stage = 'intermediate'",
    "distinct_users": """SELECT client AS "ClientId", count(*) AS n_distinct_users FROM v_inf_edge GROUP BY client""",
    "mean_shares": """SELECT client AS "ClientId", n_shares, n_users AS n_distinct_users,
        round(n_shares / n_users::DOUBLE + 1e-9, 6) AS mean_shares_per_user
        FROM v_person JOIN v_counted USING (client) WHERE stage = 'influencer'""",
    "client_coupon": """SELECT DISTINCT client AS "ClientId", code AS coupon FROM v_inf_edge""",
    "client_coupon_or_stop": """SELECT client AS "ClientId",
        CASE WHEN count(DISTINCT code) > 1 THEN error('more than one coupon') ELSE min(code) END AS coupon
        FROM v_inf_edge GROUP BY client""",
    "coupon_conflicts": """SELECT client AS "ClientId", count(DISTINCT code) AS n_coupons,
        (count(DISTINCT code) <> 1)::BIGINT AS has_conflict FROM v_inf_edge GROUP BY client""",
    "client_zipcodes": """SELECT client AS "ClientId", zip AS "ZipCode",
        count(*) OVER (PARTITION BY client) AS delivery_zipcodes FROM v_zip_of""",
    "client_stores": """SELECT client AS "ClientId", store AS "StoreName",
        count(*) OVER (PARTITION BY client) AS delivery_stores FROM v_store_of""",
    "client_weeks": """SELECT client AS "ClientId", week,
        count(*) OVER (PARTITION BY client) AS n_active_weeks FROM v_week_of""",
    "shares_by_week": """SELECT client AS "ClientId", substr(week, 3) AS week, count(*) AS n_users
        FROM v_inf_edge GROUP BY ALL""",
    "self_interactions": """SELECT client AS "ClientId",
        coalesce(max(n) FILTER (giver = taker), 0) AS auto_interactions FROM v_edge GROUP BY client""",
    "vir_users": """SELECT client AS "ClientId", round(vir_users + 1e-9, 6) AS vir_users FROM v_scaled""",
    "vir_physical": """SELECT client AS "ClientId", round(vir_physical + 1e-9, 6) AS vir_physical FROM v_scaled""",
    "vir_temp": """SELECT client AS "ClientId", round(vir_temp + 1e-9, 6) AS vir_temp FROM v_scaled""",
    "cumulative_uses": """SELECT client AS "ClientId", day::VARCHAR AS day, n AS uses, x, y::BIGINT AS y, u0
        FROM v_use_point""",
    "virality_curve": """SELECT client AS "ClientId", x, u0, k,
        round(CASE WHEN k = 1 THEN u0 * x ELSE u0 * (pow(k, x) - 1) / (k - 1) END + 1e-9, 6) AS predicted
        FROM v_use_point, (VALUES (0.9::DOUBLE), (1.0::DOUBLE), (1.002::DOUBLE)) AS g(k)""",
    "k_factor": """SELECT client AS "ClientId", round(k + 5e-7, 3) AS k_factor FROM v_use_fit""",
    "k_factor_events": """SELECT client AS "ClientId", round(k + 5e-7, 3) AS k_factor FROM v_event_fit""",
    "delivery_date": """SELECT order_id AS "Id", fecha::VARCHAR AS fecha FROM v_arrival""",
    "week_start": """SELECT order_id AS "Id", semana::VARCHAR AS semana, monday::VARCHAR AS monday
        FROM v_arrival JOIN v_calendar USING (fecha, monday)""",
    "order_lines": """SELECT tienda AS storeid, cliente, sku AS "Sku", round(price::DOUBLE + 1e-9, 6) AS "PriceExclTax",
        round(cost::DOUBLE + 1e-9, 6) AS costo, category AS categoria, category_id::BIGINT AS catid,
        zip AS "ZipCode_tienda", round(lat + 1e-9, 6) AS "Latitude", round(lon + 1e-9, 6) AS "Longitude",
        fecha::VARCHAR AS fecha, semana::VARCHAR AS semana FROM v_line""",
    "customer_lifetime": """SELECT cliente, born::VARCHAR AS nacimiento, last::VARCHAR AS ultimopedido
        FROM v_lifetime""",
    "customer_history": "SELECT cliente, skus AS skuhistoricos, cats AS catshistoricas FROM v_lifetime",
    "weekly_customer_store": """SELECT semana::VARCHAR AS semana, tienda, cliente, round(gmv::DOUBLE + 1e-9, 6) AS gmv,
        round(cost::DOUBLE + 1e-9, 6) AS costo, skus, zip AS "ZipCode_tienda", cats AS categorias, round(gm + 1e-9, 6) AS gm
        FROM v_store_week_client""",
    "daily_order_flag": "SELECT fecha::VARCHAR AS fecha, cliente, pedido FROM v_order_day",
    "weekly_frequency": "SELECT semana::VARCHAR AS semana, cliente, n AS frecuencia FROM v_order_days",
    "store_week_customers": """SELECT semana::VARCHAR AS semana, tienda, zip AS "ZipCode_tienda",
        round(lat + 1e-9, 6) AS "Latitude", round(lon + 1e-9, 6) AS "Longitude", clients AS clientesactivos FROM v_store_week""",
    "category_flags": f"""SELECT semana::VARCHAR AS semana, cliente, {FLAGS} FROM v_line GROUP BY semana, cliente""",
    "active_flag": "SELECT cliente, active AS activo1 FROM v_activity",
    "behaviour": """SELECT semana::VARCHAR AS semana, born::VARCHAR AS nacimiento, last::VARCHAR AS ultimopedido,
        active AS activo1, cliente, tienda, zip AS "ZipCode_tienda", round(gmv::DOUBLE + 1e-9, 6) AS gmv,
        freq AS frecuencia, clients AS clientesactivos, round(lat + 1e-9, 6) AS "Latitude", round(lon + 1e-9, 6) AS "Longitude",
        skus, cats AS categorias, round(cost::DOUBLE + 1e-9, 6) AS costo, round(gm + 1e-9, 6) AS gm,
        all_skus AS skuhistoricos, all_cats AS catshistoricas, round(aov + 1e-9, 6) AS "AOV" FROM v_behaved""",
    "behaviour_once": """SELECT semana::VARCHAR AS semana, born::VARCHAR AS nacimiento, last::VARCHAR AS ultimopedido,
        active AS activo1, cliente, tienda, zip AS "ZipCode_tienda", round(gmv::DOUBLE + 1e-9, 6) AS gmv,
        freq AS frecuencia, clients AS clientesactivos, round(lat + 1e-9, 6) AS "Latitude", round(lon + 1e-9, 6) AS "Longitude",
        skus, cats AS categorias, round(cost::DOUBLE + 1e-9, 6) AS costo, round(gm + 1e-9, 6) AS gm,
        all_skus AS skuhistoricos, all_cats AS catshistoricas, round(aov + 1e-9, 6) AS "AOV" FROM v_behaved_once""",
    "client_means": f"""SELECT client AS "ClientId", {MEANS}, round(aov + 1e-9, 6) AS "mean_AOV" FROM v_client_mean""",
    "child_sharing": """SELECT client AS "ClientId", n_children, n_sharing AS n_sharing_children,
        round(rate + 1e-9, 6) AS child_sharing_rate FROM v_sharing""",
    "child_behaviour": f"""SELECT parent AS "parent_Id", child AS cliente, {MEANS}, round(aov + 1e-9, 6) AS "mean_AOV"
        FROM v_child_mean""",
    "active_child_fraction": """SELECT client AS "ClientId", round(fraction + 1e-9, 6) AS active_child_fracc
        FROM v_child_active""",
    "self_invitations": """SELECT client AS "ClientId", max((giver IS NOT DISTINCT FROM taker)::BIGINT) AS invites_own_number,
        max((child = client)::BIGINT) AS invites_own_id FROM v_edge GROUP BY client""",
    "parent_behaviour": f"""SELECT client AS "ClientId", {MEANS}, round(aov + 1e-9, 6) AS "mean_AOV" FROM v_parent_metric""",
    "users_metrics": f"""SELECT client AS "ClientId", {MEANS}, round(aov + 1e-9, 6) AS "mean_AOV",
        round(rate + 1e-9, 6) AS child_sharing_rate, round(fraction + 1e-9, 6) AS active_child_fracc, NULL::BIGINT AS cliente
        FROM v_parent_metric
        UNION ALL
        SELECT parent, {MEANS}, round(aov + 1e-9, 6), NULL, NULL, child FROM v_child_mean""",
    "influencer_profile": f"""SELECT client AS "ClientId", phone AS id, name AS label, n_shares,
        round(q.active + 1e-9, 6) AS active, round(freq + 1e-9, 6) AS mean_freq, round(gmv + 1e-9, 6) AS mean_gmv,
        round(aov + 1e-9, 6) AS "mean_AOV", round(rate + 1e-9, 6) AS child_sharing_rate,
        round(fraction + 1e-9, 6) AS active_child_fracc
        FROM v_person JOIN v_parent_metric q USING (client) WHERE stage = 'influencer'""",
    "virality_score": """SELECT client AS "ClientId", round(score + 1e-9, 6) AS virality_score
        FROM v_scored WHERE stage = 'influencer'""",
    "influencer_ranking": f"SELECT {FINAL_STAGE} FROM v_final_stage WHERE stage = 'influencer'",
    "intermediate_users": f"SELECT {SHORT_STAGE} FROM v_final_stage WHERE stage = 'intermediate'",
    "passive_users": f"SELECT {SHORT_STAGE} FROM v_final_stage WHERE stage = 'passive'",
    "user_stages": f"SELECT {FINAL_STAGE} FROM v_final_stage",
    "user_interactions": f"SELECT {FINAL_EDGE} FROM v_final_edge",
    "sink_user_stages": f"SELECT {FINAL_STAGE} FROM v_final_stage",
    "sink_user_interactions": f"SELECT {FINAL_EDGE} FROM v_final_edge",
    "mape": """SELECT event_type, round(100 * avg(abs((t - p) / t)) + 1e-9, 6) AS mape FROM v_forecast WHERE t <> 0
        GROUP BY event_type""",
    "mape_shifted": """SELECT event_type,
        round(100 * avg(CASE WHEN t = 0 THEN abs(1 - (p + 1)) ELSE abs((t - p) / t) END) + 1e-9, 6) AS mape
        FROM v_forecast GROUP BY event_type""",
    "mape_one_row": """SELECT event_id, round(CASE WHEN t <> 0 THEN abs(t - p) / t END + 1e-9, 6) AS mape
        FROM v_forecast""",
}

ORACLE: dict[str, str] = {name: _with(select) for name, select in SELECTS.items()}
