"""segspark: keyed statistics, interval algebra, mixtures and trial scoring as Spark plans."""
