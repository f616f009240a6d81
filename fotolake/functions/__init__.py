"""fotolake.functions"""
