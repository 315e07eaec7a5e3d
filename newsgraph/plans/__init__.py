"""Plans: fixture derivations, the batch graph-event plan and the registered queries."""
