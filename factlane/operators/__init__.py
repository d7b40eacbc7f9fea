"""DataFrame -> DataFrame operators and Column builders."""
