"""From syntax trees to DataFrames: frames, scopes, expressions and the lowering itself."""
