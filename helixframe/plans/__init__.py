"""Plans: the rule engine, reports, and the driver's tables as annotation."""
