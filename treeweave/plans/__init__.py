"""Join trees: counting, reduction, evaluation strategies, sizing and workloads."""
