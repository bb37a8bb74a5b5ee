"""DataFrame operators: transactions, covers, mining, rules, pairs, samplers, learners, evaluation."""
