"""Domain operators over the (symbol, trading_date) panel."""
