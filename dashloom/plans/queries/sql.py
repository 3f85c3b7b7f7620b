"""SQL text shared by the queries' oracle SQL."""

EVENT_VALUE = "cast(value as decimal(12,2))"
NET_PRICE = "cast(l_extendedprice as decimal(12,2)) * (1 - cast(l_discount as decimal(4,2)))"
REVENUE = f"cast(sum({NET_PRICE}) as double)"
ORDER_TOTAL = "cast(sum(cast(o_totalprice as decimal(12,2))) as double)"
VALUE_TOTAL = f"cast(sum({EVENT_VALUE}) as double)"
