"""The reports: thin compositions of operators, each able to run one day or a range."""
