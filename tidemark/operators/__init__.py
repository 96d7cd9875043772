"""DataFrame operators: keyed writes, pages, matching, budgets, policies and differences."""
