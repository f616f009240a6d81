"""fotolake.sources"""
