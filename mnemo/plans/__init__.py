"""Query plans: the registered queries (catalog) and multi-step workflows."""
