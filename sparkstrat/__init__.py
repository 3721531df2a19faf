"""A PySpark-native engine for typed strategy graphs: operators as columns, windows, joins and ordered folds."""
