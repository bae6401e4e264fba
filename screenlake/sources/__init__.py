"""Sources and sinks: labelled samples by name, and the ledger of runs."""
