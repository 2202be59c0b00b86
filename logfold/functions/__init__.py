"""Part of logfold."""
