"""Plan helpers shared by operators: materialised stages, greedy folds, graph components."""
