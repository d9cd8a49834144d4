"""Reading, contracts, normalisation and writing of tables."""
