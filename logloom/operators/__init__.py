"""DataFrame operators: filters, aggregates, rankings, rules, series, encoders, metric history."""
