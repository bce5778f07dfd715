"""Schemas of the inputs the operators are meant for; names may differ, they are arguments."""

INPUTS = {
    "company_year": (
        "company_id bigint NOT NULL, sector string NOT NULL, reg_region string NOT NULL, "
        "cap_region string, year int NOT NULL, revenue decimal(18,2), "
        "sales_profit decimal(18,2), net_profit decimal(18,2)"
    ),
    "listing": (
        "listing_id bigint NOT NULL, object_type string NOT NULL, price decimal(12,2), "
        "area double, rooms int, distance_km double, place string NOT NULL"
    ),
    "ticket_order": (
        "order_id bigint NOT NULL, user_id bigint NOT NULL, event_id bigint NOT NULL, "
        "event_type string NOT NULL, device string, price decimal(12,2), ts timestamp_ntz NOT NULL"
    ),
    "game": (
        "game_id bigint NOT NULL, platform string NOT NULL, genre string, year int, "
        "sales_a double NOT NULL, sales_b double NOT NULL, sales_c double NOT NULL, "
        "user_score double, critic_score double"
    ),
    "talk": (
        "talk_id bigint NOT NULL, conference_id bigint NOT NULL, speaker_id bigint NOT NULL, "
        "topics array<string> NOT NULL, reaction string NOT NULL, length_s int, "
        "starts timestamp_ntz NOT NULL"
    ),
    "establishment": (
        "place_id bigint NOT NULL, niche string NOT NULL, district string NOT NULL, "
        "avg_check decimal(12,2), rating double, features string"
    ),
    "session": (
        "session_id bigint NOT NULL, user_id bigint NOT NULL, grp string NOT NULL, "
        "started timestamp_ntz NOT NULL, success boolean NOT NULL, page_views int NOT NULL, "
        "registered boolean NOT NULL"
    ),
    "delivery_event": (
        "user_id bigint NOT NULL, city string NOT NULL, ts timestamp_ntz NOT NULL, "
        "event string NOT NULL, order_id bigint, value decimal(12,2), restaurant_id bigint, "
        "margin decimal(12,2)"
    ),
    "startup": (
        "company_id bigint NOT NULL, category string, funding decimal(18,2), founded date, closed date"
    ),
}
